"""Judging hits along a frontier: only questions that may still grow ask for more votes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.cache_table import CacheTable, through
from corpusmill.operators.lineage import checkpointed


def judge_frontier(hits: DataFrame, pair_key: Column, judge: Callable[[DataFrame], DataFrame], keep: Callable[[Column], Column],
                   sizes: Sequence[int], grow_from: float, votes: CacheTable) -> tuple[DataFrame, DataFrame, list[int]]:
    """Votes for as many hits of each question as its growth asks for.

    ``hits``: query_id, rank (from 1) and whatever ``judge`` needs; ``pair_key`` names what
    a vote depends on (question, text, model), so that equal pairs are asked once, in this
    call and in later ones. ``judge`` gets the pairs without a vote and returns them with
    ``value``. ``keep`` says of a vote whether the hit stays. At each size, a question goes
    on to the next only if at least ``grow_from`` of that size is kept.

    Returns the judged hits (with ``votes`` and ``keep``) within the size each question ended
    at, the sizes (query_id, top_k, n_kept), and the number of model calls of each step.
    """
    keyed = checkpointed(hits.withColumn("pair_key", pair_key))
    state = checkpointed(keyed.select("query_id").distinct().select(
        "query_id", F.lit(0).alias("top_k"), F.lit(0).cast("bigint").alias("n_kept"), F.lit(True).alias("open")))
    judged, calls = None, []
    for at, size in enumerate(sizes):
        low = sizes[at - 1] if at else 0
        asked = keyed.where((F.col("rank") > low) & (F.col("rank") <= size)).join(
            state.where("open").select("query_id"), "query_id", "left_semi")
        answered, asked_now = through(votes, asked, "pair_key", judge)
        step = checkpointed(answered.withColumnRenamed("value", "votes").withColumn("keep", keep(F.col("votes"))))
        calls.append(asked_now)
        judged = step if judged is None else judged.unionByName(step)
        kept = step.groupBy("query_id").agg(F.count_if("keep").alias("new"))
        total = F.col("n_kept") + F.coalesce("new", F.lit(0))
        moved = state.join(kept, "query_id", "left")
        state = checkpointed(moved.select(
            "query_id", F.when(F.col("open"), size).otherwise(F.col("top_k")).alias("top_k"),
            F.when(F.col("open"), total).otherwise(F.col("n_kept")).alias("n_kept"),
            (F.col("open") & (total / size >= grow_from)).alias("open")))
        if state.where("open").isEmpty():
            break
    return judged.drop("pair_key"), state.select("query_id", "top_k", "n_kept"), calls
