"""Summaries: a fold over the chunks of each document, and further passes over the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.let import let
from corpusmill.functions.outline import cite_fallback, good_lines, strip_intro, strip_recursion_marks
from corpusmill.functions.text import est_tokens, letters, reading_minutes
from corpusmill.operators.documents import MIN_TOKENS
from corpusmill.operators.lineage import checkpointed
from corpusmill.operators.scratch import scratch_folder
from corpusmill.operators.splitting import chunk_bounds, chunk_size, units

CARRIED_LINES = 10


def chunk_array(text: Column, limit: int, overlap: int) -> Column:
    """Chunks of a text as an array, for folds that must see them in order."""
    found = units(text)
    sizes = F.transform(found, lambda u: est_tokens(u))
    return F.transform(chunk_bounds(sizes, limit, overlap), lambda b: F.array_join(
        F.slice(found, b["start"] + 1, b["end"] - b["start"]), " "))


def without_intro(reply: Column) -> Column:
    """The reply without stock preambles; only replies that mention one are taken apart."""
    return F.when(reply.rlike("(?i)breath|i'll summarize"),
                  F.array_join(strip_intro(F.split(reply, "\n")), "\n")).otherwise(reply)


def fold_chunks(chunks: Column, model, page: Column | None = None, label: Column | None = None) -> Column:
    """Summaries of the chunks in order; each call sees the last lines of the summary before it."""
    page = F.lit(None).cast("bigint") if page is None else page
    label = F.lit(None).cast("string") if label is None else label
    start = F.struct(F.expr("cast(array() as array<string>)").alias("previous"),
                     F.expr("cast(array() as array<string>)").alias("summaries"))

    def step(state: Column, chunk: Column) -> Column:
        lines = cite_fallback(good_lines(let(model(chunk, state["previous"]), without_intro)), page, label)

        def remember(ls: Column) -> Column:
            tail = F.slice(ls, F.greatest(F.size(ls) - CARRIED_LINES + 1, F.lit(1)), F.lit(CARRIED_LINES))
            return F.struct(tail.alias("previous"),
                            F.concat(state["summaries"], F.array(F.array_join(ls, "\n"))).alias("summaries"))

        # the one-element transform names the cleaned lines once for all their uses
        return F.transform(F.array(lines), remember)[0]

    return F.aggregate(chunks, start, step)["summaries"]


def fold_rounds(rows: DataFrame, chunks: str, model, name: str, page: str | None = None, label: str | None = None) -> DataFrame:
    """``rows`` with the summaries of their ``chunks`` as ``name``, for models that run in Python.

    A wavefront: the chunks are written once, a row each, in ranges of their place. Round i reads
    the chunks at place i, joins the last lines of the round before (one narrow row per
    document) and calls the model, batch by batch. A round writes the summaries and last lines of
    the documents that still have a chunk, and nothing else; so no call is repeated and no chunk
    is written again. ``page`` and ``label`` name columns for citations.
    """
    spark = rows.sparkSession
    data = checkpointed(rows.withColumn("_id", F.monotonically_increasing_id()))
    cite = [F.lit(None).cast(kind).alias(alias) if given is None else F.col(given).cast(kind).alias(alias)
            for given, alias, kind in ((page, "_page", "bigint"), (label, "_label", "string"))]
    pieces = scratch_folder(spark, "chunks")
    (data.select("_id", *cite, F.posexplode(chunks).alias("_i", "_chunk")).repartitionByRange("_i", F.xxhash64("_id"))
     .sortWithinPartitions("_i").write.parquet(pieces))
    stored = spark.read.parquet(pieces)
    last = stored.agg(F.max("_i")).first()[0]
    carried, rounds = None, []
    for i in range(0 if last is None else last + 1):
        live = stored.where(F.col("_i") == i)  # files and row groups of other places are skipped
        live = live.withColumn("_previous", F.expr("cast(array() as array<string>)")) if carried is None else live.join(carried, "_id")
        replied = live.withColumn("_reply", model(F.col("_chunk"), F.col("_previous")))
        lines = replied.withColumn("_lines", cite_fallback(good_lines(without_intro(F.col("_reply"))), F.col("_page"), F.col("_label")))
        path = scratch_folder(spark, "round")
        lines.select("_id", "_i", F.array_join("_lines", "\n").alias("_text"), F.slice(
            "_lines", F.greatest(F.size("_lines") - CARRIED_LINES + 1, F.lit(1)), F.lit(CARRIED_LINES)).alias("_previous")).write.parquet(path)
        rounds.append(path)
        carried = spark.read.parquet(path).select("_id", "_previous")
    empty = F.expr("cast(array() as array<string>)")
    if not rounds:
        return data.withColumn(name, empty).drop("_id")
    texts = spark.read.parquet(*rounds).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_text"))).alias("_all"))
    found = F.coalesce(F.transform("_all", lambda s: s["_text"]), empty)
    return data.join(texts, "_id", "left").withColumn(name, found).drop("_id", "_all")


def folded(rows: DataFrame, chunks: str, model, name: str, page: str | None = None, label: str | None = None) -> DataFrame:
    if getattr(model, "in_python", False):
        return fold_rounds(rows, chunks, model, name, page, label)
    return rows.withColumn(name, fold_chunks(F.col(chunks), model, *(None if c is None else F.col(c) for c in (page, label))))


def assemble(summaries: Column) -> Column:
    """One text, with a numbered header before each chunk when there are several."""
    n = F.size(summaries).cast("string")
    marked = F.transform(summaries, lambda s, i: F.concat(
        F.when(i > 0, F.lit("- ---\n")).otherwise(F.lit("")), F.lit("- Chunk "), (i + 1).cast("string"),
        F.lit("/"), n, F.lit("\n"), s))
    return F.when(F.size(summaries) > 1, F.array_join(marked, "\n")).otherwise(F.array_join(summaries, "\n"))


def summarize(docs: DataFrame, model, context: int = 4096, n_recursion: int = 0, text: str = "text") -> DataFrame:
    """Summary per document and, per recursion, a summary of the summary.

    A pass that changes nothing or leaves too little text ends the recursion for
    that document.
    """
    limit, overlap = chunk_size("summarize", context)
    kept = [c for c in docs.columns if c != text]
    out = docs.select(*kept, chunk_array(F.col(text), limit, overlap).alias("_chunks"))
    out = folded(out, "_chunks", model, "_s")
    out = out.select(*kept, F.size("_chunks").alias("n_chunk"), assemble(F.col("_s")).alias("summary_0"))
    limit, overlap = chunk_size("recursive_summary", context)
    for i in range(1, n_recursion + 1):
        # stored, so that no pass repeats the model calls of the pass before
        out = checkpointed(out)
        before = F.col(f"summary_{i - 1}")
        again = out.withColumn("_again", strip_recursion_marks(before))
        again = again.withColumn("_parts", chunk_array(F.col("_again"), limit, overlap))
        again = folded(again, "_parts", model, "_s")
        useful = before.isNotNull() & (est_tokens(F.col("_again")) > MIN_TOKENS)
        again = again.withColumn("_next", F.when(useful, assemble(F.col("_s"))))
        out = again.withColumn(f"summary_{i}", F.when(F.col("_next") != before, F.col("_next"))).drop("_again", "_parts", "_s", "_next")
    passes = [f"summary_{i}" for i in range(n_recursion + 1)]
    out = out.withColumn("summary", F.coalesce(*[F.col(p) for p in reversed(passes)]))
    out = out.withColumn("recursive_summaries", F.map_filter(
        F.create_map(*[x for i, p in enumerate(passes) for x in (F.lit(i), F.col(p))]), lambda k, v: v.isNotNull()))
    return out.select(*kept, "n_chunk", "summary", "recursive_summaries",
                      reading_minutes(letters(F.col("summary"))).alias("sum_reading_length"),
                      est_tokens(F.col("summary")).alias("sum_tkn_length"))


def metadata_header(item: Column, reading_minutes_: Column, author: Column, chapters: Column, today: Column,
                    section: Column, title_known: Column) -> Column:
    """The block of facts a model gets with each chunk."""
    def tag(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>\n"), value, F.lit(f"\n</{name}>")))

    return F.concat_ws(
        "\n", F.lit("<text_metadata>"), F.when(~title_known, tag("title", F.trim(item))),
        tag("reading_length", F.concat(F.format_string("%.1f", reading_minutes_), F.lit(" minutes"))),
        tag("author", F.trim(author)), tag("youtube_chapters", chapters), tag("today", today),
        tag("section_number", section), F.lit("</text_metadata>"))
