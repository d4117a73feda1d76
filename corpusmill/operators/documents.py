"""Documents and chunks as rows: text, typed core columns and a metadata map."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.html import clean_if_html, page_title
from corpusmill.functions.text import content_hash, doc_reading_time, est_tokens, repair_double_encoding, strip

MIN_TOKENS = 20
MAX_TOKENS = 10_000_000
MIN_READING_MINUTES = 0.1
MIN_LANGUAGE_PROBABILITY = 0.5
AUTHOR_KEYS = ("Author", "authors", "Authors")


def metadata_map(columns: dict[str, Column]) -> Column:
    """MAP<STRING,STRING> of the values that are there."""
    entries = F.filter(F.array(*[
        F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")) for name, value in columns.items()]),
        lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def one_author(metadata: Column) -> Column:
    """Fold the spellings of the author key into ``author``; the last spelling wins."""
    found = F.coalesce(*[F.try_element_at(metadata, F.lit(k)) for k in reversed(AUTHOR_KEYS)])
    rest = F.map_filter(metadata, lambda k, v: ~k.isin(*AUTHOR_KEYS) & ~((k == "author") & found.isNotNull()))
    return F.when(found.isNotNull(), F.map_concat(rest, F.create_map(F.lit("author"), found))).otherwise(metadata)


def merged_tag(old: Column, new: Column) -> Column:
    """Source tag of a chunk once its loader's tag is added."""
    base = F.trim(F.replace(F.coalesce(old, F.lit("")), F.lit("unset"), F.lit("")))
    added = F.when(old.isNull(), new).otherwise(F.concat(base, F.lit(" "), new))
    return F.when(new.isNull() | (new == ""), F.lit("unset")).otherwise(added)


def merged_title(old: Column, given: Column, fetched: Column, path: Column, playlist: Column | None = None) -> Column:
    """The chunk's own title, else the given one, else the page's; a second title is appended."""
    known = F.nullif(F.nullif(old, F.lit("")), F.lit("Untitled"))
    wanted = F.nullif(F.nullif(given, F.lit("")), F.lit("Untitled"))
    from_url = F.when(F.contains(F.lower(path), F.lit("http")), fetched)
    base = F.coalesce(known, wanted, from_url, F.lit("Untitled"))
    full = F.when(wanted.isNotNull() & ~F.contains(base, wanted), F.concat(base, F.lit(" - "), wanted)).otherwise(base)
    return full if playlist is None else F.when(playlist.isNotNull(), F.concat(playlist, F.lit(" - "), full)).otherwise(full)


def finish(chunks: DataFrame, file_hash: Column, tokens=est_tokens) -> DataFrame:
    """Clean the text and add the columns every chunk carries.

    ``chunks`` holds page_content, metadata and, where known, path, filetype,
    title and source_tag.
    """
    have = set(chunks.columns)
    get = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    # unfolded from an array, so that the optimizer does not clean the text again for each of its uses
    cleaned = chunks.withColumn("page_content", F.explode(F.array(repair_double_encoding(clean_if_html(F.col("page_content"))))))
    cleaned = cleaned.filter(strip(F.col("page_content")) != "")
    out = cleaned.withColumns({
        "metadata": one_author(F.col("metadata")),
        "filetype": F.coalesce(get("filetype"), F.lit("auto")),
        "source_tag": F.coalesce(get("source_tag"), F.lit("unset")),
        "title": merged_title(get("title"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.coalesce(get("path"), F.lit(""))),
        "source": F.coalesce(get("path"), get("title"), F.lit("undocumented")),
        "content_hash": content_hash(F.col("page_content")),
        "file_hash": file_hash,
        "tkn_length": tokens(F.col("page_content")),
        "doc_reading_time": doc_reading_time(F.col("page_content")),
    })
    return out.withColumn("all_hash", content_hash(F.concat(
        "content_hash", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))))))


def from_pages(pages: DataFrame) -> DataFrame:
    """Web pages as documents: visible text, with the page's own title."""
    return pages.select(
        "page_id", F.col("url").alias("path"), F.lit("url").alias("filetype"), page_title(F.col("html")).alias("title"),
        F.col("html").alias("page_content"), metadata_map({"url": F.col("url")}).alias("metadata"))


# Frequent words per language.
FREQUENT_WORDS = {
    "en": "the of and to in is it that was for on are as with be by this",
    "fr": "le la les de des et en un une est que qui dans pour au du pas avec",
    "de": "der die das und in den von zu mit ist nicht auf ein eine dem es",
    "es": "el la los de que y en un una por con para las del se es no su",
}
LANGUAGE_GAIN = 5.0


def language_probability(text: Column) -> Column:
    """Share of words that are frequent in the likeliest language, times a fixed gain, at most 1.

    A stand-in for a language detector: 1.0 for ordinary prose, near 0 for debris.
    One pass over the words in Arrow batches; a pattern per language would read
    every text several times.
    """
    listed = [frozenset(words.split()) for words in FREQUENT_WORDS.values()]
    known = frozenset().union(*listed)
    word = re.compile(r"[^\W\d_]+")

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        def one(body: str | None) -> float | None:
            if body is None:
                return None
            found = word.findall(body.lower())
            counts = Counter(w for w in found if w in known)
            best = max(sum(n for w, n in counts.items() if w in words) for words in listed)
            return min(1.0, LANGUAGE_GAIN * best / max(1, len(found)))

        return texts.map(one)

    return rate(text)


def gate(chunks: DataFrame, keys: list[str], min_tokens: int | None = MIN_TOKENS, max_tokens: int | None = MAX_TOKENS,
         min_minutes: float | None = MIN_READING_MINUTES, min_language: float | None = None) -> DataFrame:
    """One row per loaded file with its totals and why it is refused, if it is.

    The default limits are those of one file; a limit of None is not asked.
    Totals are combined on the map side, so a file with many chunks costs no more.
    """
    if min_language is not None:
        chunks = chunks.withColumn("_p", language_probability(F.col("page_content")))
    parts = [F.sum("tkn_length").alias("tokens"), F.sum("doc_reading_time").alias("minutes"),
             F.count(F.lit(1)).alias("n_chunks")]
    if min_language is not None:
        parts.append(F.avg("_p").alias("language"))
    totals = chunks.groupBy(*keys).agg(*parts)
    asked = [(min_tokens, lambda least: F.col("tokens") <= least, "too few tokens"),
             (max_tokens, lambda most: F.col("tokens") >= most, "too many tokens"),
             (min_language, lambda least: F.col("language") <= least, "unlikely language"),
             (min_minutes, lambda least: F.round("minutes", 6) <= least, "too short to read")]
    reasons = [F.when(fails(limit), reason) for limit, fails, reason in asked if limit is not None]
    return totals.withColumn("load_error", F.coalesce(*reasons, F.lit(None).cast("string")))


def refuse_all_failed(gated: DataFrame) -> None:
    if gated.filter(F.col("load_error").isNull()).isEmpty():
        raise ValueError("no document was loaded")
