"""Greedy cuts along a sequence of any length, found in parallel.

Where a batch ends depends on where it begins, so a greedy sequence looks serial.
But every row has one next cut: the row that would begin the next batch if a batch
began here, and it lies within a bounded distance. The sequence is dealt into blocks;
each block tells, for every row in which a batch may enter it, where the sequence enters
the next block and how many batches lie between. These maps are joined with their
neighbours, doubling the blocks they span, until one spans all; on the way back they
hand every block the row where it is entered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.lineage import checkpointed
from corpusmill.operators.ordered import running_totals

SPAN = 16           # most rows of a block, in batches of the largest count
ORDER_ROWS = 4_096  # consecutive ids that are summed in one task


def next_cuts(ends: np.ndarray, limit: int, most: int) -> np.ndarray:
    """For each row the first later one that begins a new batch, if a batch begins at it.

    ``ends``: running sums of the sizes. A batch holds at most ``most`` rows and, unless it is
    a single row, at most ``limit`` in all. Rows behind the last are where the last batches end.
    """
    before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    at = np.arange(len(ends))
    return np.maximum(at + 1, np.minimum(np.searchsorted(ends, before + limit, side="right"), at + most))


def _map_of(block_rows: int, limit: int, most: int):
    """One row per block: for each of its first ``most`` rows the exit, and the batches on the way."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", ignore_index=True)
        first = int(group["at"].iloc[0])
        follow = np.minimum(next_cuts(group["ends"].to_numpy("i8") - int(group["before"].iloc[0]), limit, most), len(group))
        own = min(block_rows, len(group))
        place, batches = follow[:own].copy(), np.ones(own, "i8")
        inside = np.flatnonzero(place < own)
        while len(inside):  # each step doubles what a pointer spans; the targets are read before they move
            target = place[inside]
            place[inside], batches[inside] = place[target], batches[inside] + batches[target]
            inside = inside[place[inside] < own]
        entries = min(most, own)
        return pd.DataFrame({"block": [first // block_rows], "exits": [(place[:entries] - block_rows).astype("i4")],
                             "batches": [batches[:entries]]})

    return run


def _number(block_rows: int, limit: int, most: int, keep: list[str]):
    """Batch numbers of a block's rows, from where it is entered."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", ignore_index=True)
        follow = next_cuts(group["ends"].to_numpy("i8") - int(group["before"].iloc[0]), limit, most)
        starts, at = np.zeros(len(group), "i8"), int(group["entry"].iloc[0])
        while at < len(group):
            starts[at] = 1
            at = int(follow[at])
        # rows before the entry belong to the batch that began in an earlier block
        return group.assign(batch=int(group["first_batch"].iloc[0]) - 1 + np.cumsum(starts))[keep]

    return run


def greedy_batches(df: DataFrame, order: str, size: Column, limit: int, most: int, name: str = "batch",
                   block_rows: int | None = None) -> DataFrame:
    """``order`` (a unique integer) and the number of its batch, from 0 along ``order``.

    A batch takes rows while their sizes sum to at most ``limit`` and there are at most
    ``most`` of them; a row above the limit is a batch of its own. Null sizes are 0, rows
    without an order have no place and are left out. No task holds more rows than a block
    and one largest batch, and rounds grow with the logarithm of the number of blocks.
    """
    if limit < 1 or most < 1:
        raise ValueError("a batch must have room for something")
    block_rows = max(most, block_rows or SPAN * most)
    sized = df.where(F.col(order).isNotNull()).select(F.col(order).alias("id"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))
    summed = running_totals(sized, [], ["id"], F.floor(F.col("id") / ORDER_ROWS),
                            {"ends": F.col("size"), "at": F.lit(1).cast("bigint")})
    rows = checkpointed(summed.select("id", (F.col("at") - 1).alias("at"), "ends", (F.col("ends") - F.col("size")).alias("before"),
                                      F.floor((F.col("at") - 1) / block_rows).cast("bigint").alias("block")))
    # a block's last pointers lead into the next one: its first rows are copied back
    border = rows.where((F.col("block") > 0) & (F.col("at") % block_rows < most)).withColumn("block", F.col("block") - 1)
    maps = [checkpointed(rows.unionByName(border).groupBy("block").applyInPandas(
        _map_of(block_rows, limit, most), "block bigint, exits array<int>, batches array<bigint>"))]
    count = maps[0].count()
    step = 1
    while step < count:
        left = maps[-1].where(F.col("block") % (2 * step) == 0).alias("l")
        right = maps[-1].where(F.col("block") % (2 * step) == step).select(
            (F.col("block") - step).alias("block"), F.col("exits").alias("on"), F.col("batches").alias("more"))
        joined = left.join(right, "block", "left")
        # new names: a column inside a lambda may be taken for the alias beside it
        alone = F.col("on").isNull()
        maps.append(checkpointed(joined.select(
            "block", F.when(alone, F.col("exits")).otherwise(F.transform("exits", lambda e: F.get("on", e))).alias("far"),
            F.when(alone, F.col("batches")).otherwise(F.zip_with(
                "batches", "exits", lambda n, e: n + F.get("more", e))).alias("all")).toDF("block", "exits", "batches")))
        step *= 2
    entries = maps[0].where("block = 0").select("block", F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("first_batch"))
    for known in reversed(maps[:-1]):
        step //= 2
        handed = entries.join(known, "block").select(
            (F.col("block") + step).alias("block"), F.get("exits", F.col("entry")).alias("entry"),
            (F.col("first_batch") + F.get("batches", F.col("entry"))).alias("first_batch"))
        # the next block exists unless the sequence ended
        entries = checkpointed(entries.unionByName(handed.where(F.col("block") < count)))
    kind = df.schema[order].dataType.simpleString()
    return (rows.join(entries, "block").groupBy("block")
            .applyInPandas(_number(block_rows, limit, most, ["id", "batch"]), "id bigint, batch bigint")
            .select(F.col("id").cast(kind).alias(order), F.col("batch").alias(name)))


def embedding_batches(chunks: DataFrame, id_col: str = "doc_id", max_tokens: int = 100_000,
                      max_docs: int = 1_000) -> DataFrame:
    """Greedy batches for an embedding provider, in id order: ``batch``, the id, ``tkn_length``.

    ``chunks``: a unique integer id and tkn_length.
    """
    cut = greedy_batches(chunks, id_col, F.col("tkn_length"), max_tokens, max_docs)
    return cut.join(chunks.select(id_col, "tkn_length"), id_col).select("batch", id_col, "tkn_length")
