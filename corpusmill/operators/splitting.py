"""Cutting documents into chunks, and chunks into batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import est_tokens, strip

# Chunk sizes by task, embedding batch limits.
DEFAULT_CONTEXT = 4096
MAX_CHUNK_TOKENS = 16_000
MAX_EMBED_TOKENS = 7_000
OVERLAP_TOKENS = 500
RECURSION_OVERLAP = 300
BATCH_TOKENS = 100_000
BATCH_DOCS = 1_000


def chunk_size(task: str, context: int = DEFAULT_CONTEXT) -> tuple[int, int]:
    """(size, overlap) in tokens for a task."""
    if task in ("query", "search"):
        context = min(context, MAX_EMBED_TOKENS)
    context = min(context, MAX_CHUNK_TOKENS)
    shares = {"query": 3 / 4, "search": 3 / 4, "parse": 3 / 4, "summarize": 1 / 2, "recursive_summary": 1 / 4}
    if task not in shares:
        raise ValueError(f"unknown task {task!r}")
    return int(context * shares[task]), RECURSION_OVERLAP if task == "recursive_summary" else OVERLAP_TOKENS


def units(text: Column) -> Column:
    """Smallest pieces a chunk is made of: the lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda u: strip(u) != "")


def explode_units(docs: DataFrame, text: str = "text") -> DataFrame:
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode(units(F.col(text))).alias("pos", "unit"))


def cuts(sizes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each chunk over the units: greedy, with whole units of overlap."""
    sizes = np.asarray(sizes, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    n, start, first_new, out = len(sizes), 0, 0, []
    while first_new < n:
        # the unit at first_new always goes in; the next cut is the first later unit that does not fit
        end = int(np.searchsorted(total[first_new + 2:], total[start] + limit, side="right")) + first_new + 1
        out.append((start, end))
        if end >= n:
            break
        start = max(start, int(np.searchsorted(total[:end + 1], total[end] - overlap, side="left")))
        first_new = end
    return out


def check_overlap(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit:
        raise ValueError(f"the overlap ({overlap}) must be smaller than the chunk size ({limit})")


def chunk_bounds(sizes: Column, limit: int, overlap: int) -> Column:
    """Array of (start, end) unit positions. Only the sizes travel to Python; the text does not."""
    check_overlap(limit, overlap)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(series: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            return [{"start": a, "end": b} for a, b in cuts(s, limit, overlap)]

        return series.map(one)

    return run(sizes)


def pack(docs: DataFrame, limit: int, overlap: int, text: str = "text", tokens=est_tokens) -> DataFrame:
    """Documents to chunks of whole units joined by a space: chunk_no from 0, n_chunks, page_content."""
    kept = [c for c in docs.columns if c != text]
    cut = docs.select(*kept, units(F.col(text)).alias("_units"))
    sizes = F.transform("_units", lambda u: tokens(u))
    cut = cut.withColumn("_bounds", chunk_bounds(sizes, limit, overlap))
    rows = cut.select(*kept, "_units", F.size("_bounds").alias("n_chunks"), F.posexplode("_bounds").alias("chunk_no", "_b"))
    content = F.array_join(F.slice("_units", F.col("_b.start") + 1, F.col("_b.end") - F.col("_b.start")), " ")
    return rows.select(*kept, "chunk_no", "n_chunks", content.alias("page_content"))


def fold_pages(nodes: DataFrame, keys: list[str], order: str, text: str, extra: str) -> DataFrame:
    """Nodes of one page as one document: texts in order, the distinct values of ``extra`` as a list."""
    held = F.array_sort(F.collect_list(F.struct(order, text, extra)))
    folded = nodes.groupBy(*keys).agg(held.alias("_n"))
    return folded.select(*keys, F.array_join(F.transform("_n", lambda s: s[text]), "\n").alias("page_content"),
                         F.array_distinct(F.transform("_n", lambda s: s[extra])).alias(extra))
