"""Command line: ``python -m corpusmill.cli TASK PATH [--name=value ...]``."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

# Tasks and the other names arguments go by.
TASKS = ("query", "search", "summarize", "summarize_then_query", "parse")
TASK_ALIASES = {"summary": "summarize", "summary_then_query": "summarize_then_query"}
ARGUMENT_ALIASES = {"input": "path", "source": "path", "question": "query", "out": "out_file", "output": "out_file", "format_": "format"}


def _value(text: str):
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("none", ""):
        return None
    return int(text) if text.isdigit() else text


def normalise(argv: list[str]) -> dict:
    """Arguments as one dict: kebab-case accepted, aliases resolved, bare words promoted."""
    named, bare, i = {}, [], 0
    while i < len(argv):
        token = argv[i]
        if token.startswith("--") and len(token) > 2:
            key, eq, value = token[2:].partition("=")
            key = key.replace("-", "_")
            if not eq and i + 1 < len(argv) and not argv[i + 1].startswith("--"):
                i, value, eq = i + 1, argv[i + 1], "="
            key = ARGUMENT_ALIASES.get(key, key)
            named.setdefault(key, _value(value) if eq else True)
        else:
            bare.append(token)
        i += 1
    out = {}
    if "task" in named:
        out["task"] = named.pop("task")
    elif bare:
        out["task"] = bare.pop(0)
    out["task"] = TASK_ALIASES.get(out.get("task"), out.get("task"))
    if out["task"] not in TASKS:
        raise SystemExit(f"the task is one of {', '.join(TASKS)}")
    out.update(named)
    for key in ("path", "query"):
        if bare and key not in out:
            out[key] = bare.pop(0)
    if bare:
        raise SystemExit(f"unexpected arguments: {bare}")
    return out


def parse(spark, options: dict) -> Iterator[str]:
    """Load one source, cut what is too long into chunks, and hand it out in the format asked for."""
    from pyspark.sql import functions as F

    from corpusmill.functions.filetypes import filetype_by_magic, infer_filetype
    from corpusmill.functions.text import est_tokens
    from corpusmill.operators.splitting import chunk_size, pack
    from corpusmill.sinks import formats
    from corpusmill.sources import files

    kind = options.get("filetype") or "auto"
    if kind == "auto":
        kind = spark.range(1).select(infer_filetype(F.lit(options["path"]))).first()[0]
        if kind is None:  # only the content can tell
            head = spark.read.format("binaryFile").load(options["path"]).select(filetype_by_magic(F.col("content"))).first()
            kind = (head and head[0]) or "txt"
    docs = files.load(spark, kind, options["path"]).select("path", "page_content", "metadata")
    limit, overlap = chunk_size("parse")
    short = est_tokens(F.col("page_content")) <= limit
    whole = docs.where(short).select("path", F.lit(1).alias("pos"), F.lit(1).alias("n_chunks"), "page_content", "metadata")
    cut = pack(docs.where(~short), limit, overlap, text="page_content").select(
        "path", (F.col("chunk_no") + 1).alias("pos"), "n_chunks", "page_content", "metadata")
    pieces = formats.in_order(formats.pieces(whole.unionByName(cut), options.get("format") or "text"), ["path"])
    if options.get("out_file"):
        yield f"{formats.append_lines(options['out_file'], pieces)} pieces written to {options['out_file']}"
    else:
        yield from pieces


def summarize(spark, options: dict) -> Iterator[str]:
    from corpusmill.operators.models import first_words_summary
    from corpusmill.plans.summarize import summarize as run
    from corpusmill.sources import files

    docs = files.load(spark, options.get("filetype") or "txt", options["path"]).select("path", "page_content")
    done = run(docs, first_words_summary, n_recursion=int(options.get("summary_n_recursion") or 0), text="page_content")
    for row in done.select("path", "summary", "n_chunk", "sum_tkn_length").toLocalIterator():
        yield json.dumps(row.asDict(), ensure_ascii=False)


def _asked(spark, options: dict):
    """The question, the chunks of a text source and their vectors, the built-in stand-ins, and the caches."""
    from pyspark.sql import functions as F

    from corpusmill.config import Config
    from corpusmill.functions.text import split_query
    from corpusmill.operators.cache_table import CacheTable
    from corpusmill.operators.models import first_sentence_answer, hash_embedding, overlap_votes
    from corpusmill.operators.scratch import scratch_folder
    from corpusmill.operators.splitting import chunk_size, pack
    from corpusmill.plans.task import Models
    from corpusmill.shipping import ship
    from corpusmill.sources import files

    ship(spark)
    limit, overlap = chunk_size("query")
    docs = files.load(spark, options.get("filetype") or "txt", options["path"]).select("path", F.col("page_content").alias("text"))
    chunks = pack(docs, limit, overlap).select("path", F.concat_ws("#", "path", "chunk_no").alias("chunk_id"),
                                               F.col("page_content").alias("text"))
    vectors = chunks.select("chunk_id", hash_embedding(F.col("text")).alias("embedding"))
    asked = spark.range(1).select(F.lit(0).alias("query_id"), split_query(F.lit(options["query"])).alias("q"))
    asked = asked.select("query_id", F.col("q.to_answer").alias("question"), hash_embedding(F.col("q.to_embed")).alias("embedding"))
    models = Models(lambda rows: rows.withColumn("value", overlap_votes(F.col("question"), F.col("text"))),
                    lambda rows: rows.withColumn("value", first_sentence_answer(F.col("question"), F.col("text"))), hash_embedding)
    folder = options.get("cache") or scratch_folder(spark, "task")
    days = Config(spark).cache_days
    caches = CacheTable(spark, f"{folder}/votes", "array<int>", days), CacheTable(spark, f"{folder}/replies", "string", days)
    ways = {"retrievers": options.get("retrievers") or "basic", "top_k": options.get("top_k") or "auto_200_500"}
    return asked, chunks, vectors, models, caches, ways


def search(spark, options: dict) -> Iterator[str]:
    """Chunks of a text source closest to a question and judged relevant, then the paths they come from."""
    from corpusmill.plans.task import search_task

    asked, chunks, vectors, models, (votes, _), ways = _asked(spark, options)
    found = search_task(asked, vectors, chunks, models, votes, **ways).kept.select("rank", "chunk_id").join(chunks, "chunk_id")
    for row in found.select("rank", "chunk_id", "path", "text").orderBy("rank").toLocalIterator():
        yield json.dumps(row.asDict(), ensure_ascii=False)
    for row in found.select("path").distinct().orderBy("path").toLocalIterator():
        yield f"found in {row['path']}"


def query(spark, options: dict) -> Iterator[str]:
    """The answer to a question from a text source, with its sources."""
    from corpusmill.plans.task import query_task

    asked, chunks, vectors, models, (votes, replies), ways = _asked(spark, options)
    final, found, calls = query_task(asked, vectors, chunks, models, votes, replies, **ways)
    row = final.first()
    if row is None or row["answer"] is None:
        yield "no relevant intermediate answer"
    else:
        yield row["answer"]
        yield f"missing sources: {row['missing_sources']}"
    yield f"votes asked: {sum(found.calls)}, answers asked: {calls}"


def summarize_then_query(spark, options: dict) -> Iterator[str]:
    yield from summarize(spark, options)
    yield from query(spark, options)


def main() -> None:
    from corpusmill.session import build_session

    options = normalise(sys.argv[1:])
    runs = {"parse": parse, "summarize": summarize, "search": search, "query": query, "summarize_then_query": summarize_then_query}
    for line in runs[options["task"]](build_session(), options):
        print(line)


if __name__ == "__main__":
    main()
