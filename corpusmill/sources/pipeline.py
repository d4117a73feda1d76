"""From a manifest to loaded, gated and folded documents, all on tables.

An entry carries its arguments as a map. Expanders turn recursive entries into
more entries, readers turn the entries of a file type into texts; both are looked up by
file type. An entry that cannot be loaded is a row with ``load_error``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import content_hash
from corpusmill.operators.dedup import merge_copies
from corpusmill.operators.documents import finish, gate, merged_tag, merged_title
from corpusmill.operators.lineage import checkpointed
from corpusmill.sources.manifest import ENTRY_FIELDS, RECURSIVE_TYPES, expand, with_filetype

Step = Callable[[DataFrame], DataFrame]
ENTRY = ("path", "filetype", "args")
EMPTY_MAP = "cast(map() as map<string,string>)"


def expanded(entries: DataFrame, expanders: Mapping[str, Step]) -> DataFrame:
    """Entries (path, filetype, args) with the recursive ones replaced by what they stand for.

    A child's own arguments win over those it inherits from its parent.
    """
    def children_of(pending: DataFrame) -> DataFrame:
        parts = [step(pending.filter(F.col("filetype") == kind)).select(*ENTRY) for kind, step in expanders.items()]
        return with_filetype(reduce(DataFrame.unionByName, parts))

    return expand(with_filetype(entries.select(*ENTRY)), children_of, [k for k in RECURSIVE_TYPES if k in expanders])


def inherit(own, parent):
    """Arguments of a child entry: its own, and the parent's that it does not set."""
    return F.map_concat(F.map_filter(parent, lambda k, v: ~F.map_contains_key(own, k)), own)


def reader(read: Callable[[str], str]) -> Step:
    """A reader from a function of a path: what it raises becomes the entry's ``load_error``, and the job goes on."""
    @F.pandas_udf("struct<page_content:string,load_error:string>")
    def run(paths: pd.Series) -> pd.DataFrame:
        found = []
        for path in paths:
            try:
                found.append((read(path), None))
            except Exception as error:  # noqa: BLE001 - reported with the entry
                found.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(found, columns=["page_content", "load_error"])

    def step(entries: DataFrame) -> DataFrame:
        return entries.select("path", run("path").alias("r")).select("path", "r.page_content", "r.load_error")

    return step


def read_entries(entries: DataFrame, readers: Mapping[str, Step]) -> DataFrame:
    """Texts of all entries: path, filetype, args, page_content, title, metadata, load_error.

    ``readers``: from the entries of a file type to rows (path, page_content) and,
    where known, title, metadata and load_error.
    """
    optional = {"title": "cast(null as string)", "metadata": EMPTY_MAP, "load_error": "cast(null as string)"}
    parts = []
    for kind, read in readers.items():
        mine = entries.filter(F.col("filetype") == kind)
        found = read(mine)
        for name, default in optional.items():
            if name not in found.columns:
                found = found.withColumn(name, F.expr(default))
        parts.append(mine.join(found.select("path", "page_content", *optional), "path", "left")
                     .select(*ENTRY, "page_content", *optional))
    rest = entries.filter(F.col("filetype").isNull() | ~F.col("filetype").isin(*readers))
    parts.append(rest.select(
        *ENTRY, F.lit(None).cast("string").alias("page_content"), F.lit(None).cast("string").alias("title"),
        F.expr(EMPTY_MAP).alias("metadata"), F.concat(F.lit("no loader for "), F.coalesce("filetype", F.lit("unknown type"))).alias("load_error")))
    return reduce(DataFrame.unionByName, parts)


def load_corpus(entries: DataFrame, expanders: Mapping[str, Step], readers: Mapping[str, Step],
                min_language: float | None = None, arguments: str = "warn") -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of a manifest.

    ``arguments`` says what becomes of entries with unknown arguments: strict reports them as
    failures, strip drops the arguments, warn keeps them.

    Documents: one row per distinct content, with the columns of its first entry by
    path and every source tag once; repaired, titled, sized and hashed. Failures:
    path, filetype and ``load_error`` of each entry that gave nothing: no loader, no text, or
    refused by the gate. Both come from one stored pass over the texts.
    """
    known = checkpointed(expanded(entries, expanders).dropDuplicates(["path", "filetype"]))
    if arguments not in ("strict", "warn", "strip"):
        raise ValueError("arguments are strict, warn or strip")
    proper = lambda k: k.isin(*ENTRY_FIELDS)
    if arguments == "strip":
        known = known.withColumn("args", F.map_filter("args", lambda k, v: proper(k)))
    strange = F.filter(F.map_keys("args"), lambda k: ~proper(k))
    texts = read_entries(known, readers)
    if arguments == "strict":
        texts = texts.withColumn("load_error", F.coalesce("load_error", F.when(F.size(strange) > 0, F.concat(
            F.lit("unknown arguments: "), F.array_join(F.array_sort(strange), ", ")))))
    texts = checkpointed(texts)
    given = texts.withColumns({
        "title": merged_title(F.col("title"), F.try_element_at("args", F.lit("title")), F.lit(None).cast("string"), F.col("path")),
        "source_tag": merged_tag(F.lit(None).cast("string"), F.try_element_at("args", F.lit("source_tag"))),
        "metadata": F.coalesce("metadata", F.expr(EMPTY_MAP))})
    chunks = finish(given.filter("load_error IS NULL AND page_content IS NOT NULL"),
                    content_hash(F.concat("path", F.lit("\n"), "filetype")))
    chunks = checkpointed(chunks.drop("args", "load_error"))
    gated = gate(chunks, ["path", "filetype"], min_language=min_language).select("path", "filetype", F.col("load_error").alias("refused"))
    # every entry with a text has a row of the gate
    reasons = texts.select("path", "filetype", "load_error").join(gated.withColumn("_there", F.lit(True)), ["path", "filetype"], "left")
    error = F.coalesce("load_error", "refused", F.when(F.col("_there").isNull(), F.lit("empty document")))
    failures = reasons.select("path", "filetype", error.alias("load_error")).filter("load_error IS NOT NULL").orderBy("path", "filetype")
    kept = chunks.join(gated.filter("refused IS NULL").select("path", "filetype"), ["path", "filetype"], "left_semi")
    return merge_copies(kept, "path", metadata="metadata"), failures
