"""Retrievers built on nearest-neighbour search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.vectors import dot, l2_normalise
from corpusmill.operators.lineage import checkpointed
from corpusmill.operators.search import SCORE_GUARD, hits_with, nearest, search
from corpusmill.operators.topk import top_k


def mean_vectors(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector per key, by a map-side combined aggregate."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return vectors.groupBy(*keys).agg(vector_to_array(mean).alias("embedding"))


def multi_query(corpus: DataFrame, rephrasings: DataFrame, k: int, threshold: float | None = -0.5,
                id_col: str = "chunk_id") -> DataFrame:
    """Search every rephrasing and keep each chunk once per question, at its best rank.

    ``rephrasings``: query_id, subquery_id, embedding.
    """
    sub = rephrasings.select(F.struct("query_id", "subquery_id").alias("s"), "embedding")
    numbered = sub.select(F.concat_ws("/", "s.query_id", "s.subquery_id").alias("query_id"), "embedding", "s")
    hits = search(corpus, numbered, k, threshold, id_col)
    named = hits.withColumn("query_id", F.split_part("query_id", F.lit("/"), F.lit(1)).cast(
        rephrasings.schema["query_id"].dataType))
    return named.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("best_rank"), F.max("score").alias("score"))


def parents_of(hits: DataFrame, children: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Parents of the chunks found, each once per question at its best rank. ``children``: id, parent_id."""
    found = hits_with(checkpointed(hits), children.select(F.col(id_col).alias("chunk_id"), "parent_id"), "chunk_id")
    return found.groupBy("query_id", "parent_id").agg(F.min("rank").alias("best_rank"),
                                                      F.count(F.lit(1)).alias("n_children"))


def merge(named_hits: list[DataFrame]) -> DataFrame:
    """Interleave retrievers: all first hits, then all second hits; a chunk keeps its first place."""
    parts = [h.select("query_id", "chunk_id", "rank", F.lit(i).alias("retriever")) for i, h in enumerate(named_hits)]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    place = F.struct("rank", "retriever")
    return (together.groupBy("query_id", "chunk_id").agg(F.min(place).alias("place"))
            .select("query_id", "chunk_id", "place.rank", "place.retriever"))


def sieve(merged: DataFrame, k: int) -> DataFrame:
    """Cut a merged list to ``k`` in merge order, which is not score order."""
    return top_k(merged, ["query_id"], [F.col("rank"), F.col("retriever"), F.col("chunk_id")], k, rank="pos")


def diverse(corpus: DataFrame, questions: DataFrame, k: int, fetch_k: int, weight: float = 0.5,
            id_col: str = "chunk_id") -> DataFrame:
    """Maximal marginal relevance over the ``fetch_k`` nearest chunks of each question.

    The group handed to Python is the ``fetch_k`` candidates, never the corpus.
    """
    unit = corpus.select(F.col(id_col).alias("chunk_id"), l2_normalise(F.col("embedding")).alias("embedding"))
    asked = questions.select("query_id", l2_normalise(F.col("embedding")).alias("embedding"))
    candidates = hits_with(checkpointed(nearest(unit, asked, fetch_k, "cosine")), unit, "chunk_id")
    id_type = candidates.schema["chunk_id"].dataType.simpleString()
    q_type = candidates.schema["query_id"].dataType.simpleString()

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank"], ignore_index=True)
        vectors = np.vstack(group["embedding"].to_numpy())
        relevance = 1.0 - group["distance"].to_numpy()
        between = vectors @ vectors.T
        chosen: list[int] = []
        left = list(range(len(group)))
        while left and len(chosen) < k:
            closest = between[np.ix_(left, chosen)].max(axis=1) if chosen else np.zeros(len(left))
            gain = weight * relevance[left] - (1 - weight) * closest if chosen else relevance[left]
            chosen.append(left.pop(int(np.argmax(np.round(gain, 12)))))
        out = group.loc[chosen, ["query_id", "chunk_id", "distance"]].reset_index(drop=True)
        out["pos"] = np.arange(1, len(out) + 1)
        return out

    return candidates.groupBy("query_id").applyInPandas(
        pick, f"query_id {q_type}, chunk_id {id_type}, distance double, pos bigint")


def _active_sums(unit: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``weights``: sums over the chunks inside its margin, of outer products and vectors.

    A constant is appended to each chunk. A partition adds up its own rows for all directions
    in one pass; the upper halves of the matrices are packed and meet cell by cell, so neither a
    task nor the driver sees more than one matrix per direction.
    """
    many, width = weights.shape
    upper = np.triu_indices(width)

    def run(batches):
        squares, sums = np.zeros((many, len(upper[0]))), np.zeros((many, width))
        for batch in batches:
            x = np.vstack(batch["embedding"].to_numpy())
            x = np.hstack([x, np.ones((len(x), 1))])
            inside = 1.0 + x @ weights.T > 0.0
            for q in range(many):
                own = x[inside[:, q]]
                squares[q] += (own.T @ own)[upper]
                sums[q] += own.sum(axis=0)
        packed = np.hstack([squares, sums])
        yield pd.DataFrame({"direction": np.repeat(np.arange(many), packed.shape[1]),
                            "cell": np.tile(np.arange(packed.shape[1]), many), "value": packed.ravel()})

    cells = (unit.select("embedding").mapInPandas(run, "direction int, cell int, value double")
             .groupBy("direction", "cell").agg(F.sum("value").alias("value")).toPandas())
    packed = np.zeros((many, len(upper[0]) + width))
    packed[cells["direction"], cells["cell"]] = cells["value"]
    squares = np.zeros((many, width, width))
    squares[:, upper[0], upper[1]] = squares[:, upper[1], upper[0]] = packed[:, :len(upper[0])]
    return squares, packed[:, len(upper[0]):]


def exemplar_directions(unit: DataFrame, questions: np.ndarray, n: int, cost: float = 0.1) -> tuple[np.ndarray, int, np.ndarray]:
    """Weights of linear SVMs with squared hinge loss: each question against all ``n`` chunks, classes balanced.

    Newton's method for all questions at once: a step is one pass over the chunks, and questions
    that have settled leave. The loss is piecewise quadratic, so full steps end on the
    minimum; one that does not lower a question's slope is halved for that question.
    Returns the weights, the number of passes, and the norm of each slope at the end.
    """
    x = np.hstack([questions, np.ones((len(questions), 1))])
    own, others = cost * (n + 1) / 2.0, cost * (n + 1) / (2.0 * n)
    passes = 0

    def at(weights: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal passes
        passes += 1
        squares, sums = _active_sums(unit, weights)
        mine = 1.0 - np.einsum("ij,ij->i", x[which], weights) > 0.0
        matrix = others * squares + own * np.einsum("i,ij,ik->ijk", mine, x[which], x[which])
        vector = own * mine[:, None] * x[which] - others * sums
        return matrix, vector, weights + 2.0 * (np.einsum("ijk,ik->ij", matrix, weights) - vector)

    weights = np.zeros(x.shape)
    every = np.arange(len(x))
    matrix, vector, slope = at(weights, every)
    share = np.ones(len(x))
    while True:
        active = every[np.abs(slope).max(axis=1) > 1e-9 * (1.0 + np.abs(weights).max(axis=1))]
        if not len(active):
            return weights, passes, np.linalg.norm(slope, axis=1)
        goal = np.linalg.solve(np.eye(x.shape[1]) + 2.0 * matrix[active], 2.0 * vector[active][..., None])[..., 0]
        tried = weights[active] + share[active, None] * (goal - weights[active])
        found = at(tried, active)
        better = np.linalg.norm(found[2], axis=1) < np.linalg.norm(slope[active], axis=1)
        good = active[better]
        weights[good], matrix[good], vector[good], slope[good] = tried[better], found[0][better], found[1][better], found[2][better]
        share[good] = 1.0
        share[active[~better]] /= 2.0
        if share.min() < 1e-6:
            raise RuntimeError("an exemplar's weights do not settle")


EXEMPLARS = 64  # questions whose matrices travel together


def exemplar_weights(unit: DataFrame, questions: DataFrame, n: int) -> tuple[dict, int, float]:
    """The direction of each question (by query_id), the passes made and the largest slope left, block by block."""
    block: list = []
    weights, passes, slope = {}, 0, 0.0

    def settle() -> None:
        nonlocal passes, slope
        found, more, left = exemplar_directions(unit, np.array([r["embedding"] for r in block]), n)
        weights.update({r["query_id"]: w for r, w in zip(block, found, strict=True)})
        passes, slope = passes + more, max(slope, float(left.max()))
        block.clear()

    for row in questions.orderBy("query_id").toLocalIterator():
        block.append(row)
        if len(block) == EXEMPLARS:
            settle()
    if block:
        settle()
    return weights, passes, slope


def svm_hits(corpus: DataFrame, questions: DataFrame, k: int, threshold: float = 0.0,
             id_col: str = "chunk_id") -> DataFrame:
    """Exemplar SVM: each question against the whole corpus, ranked along its fitted direction.

    ``questions``: query_id, embedding; the directions of 64 questions are fitted together.
    Scores run from the corpus's lowest value to the question's own.
    """
    asked = checkpointed(questions.select("query_id", l2_normalise(F.col("embedding")).alias("embedding")))
    unit = checkpointed(corpus.select(F.col(id_col).alias("chunk_id"), l2_normalise(F.col("embedding")).alias("embedding")))
    weights, _, _ = exemplar_weights(unit, asked, max(unit.count(), 1))
    kind = asked.schema["query_id"].dataType.simpleString()
    directions = asked.sparkSession.createDataFrame(
        [(q, [float(v) for v in w[:-1]]) for q, w in weights.items()], f"query_id {kind}, embedding array<double>")
    opposite = directions.select("query_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    top = nearest(unit, directions, k, "cosine")
    low = nearest(unit, opposite, 1, "cosine").select("query_id", (F.col("distance") - 1).alias("low"))
    own = asked.join(directions.withColumnRenamed("embedding", "d"), "query_id").select("query_id", dot(F.col("embedding"), F.col("d")).alias("own"))
    high = top.filter(F.col("rank") == 1).join(own, "query_id").select(
        "query_id", F.greatest(1 - F.col("distance"), F.col("own")).alias("high"))
    scored = top.join(high, "query_id").join(low, "query_id").withColumn(
        "score", (1 - F.col("distance") - F.col("low")) / (F.col("high") - F.col("low") + SCORE_GUARD))
    return scored.filter(F.col("score") >= threshold).select("query_id", "chunk_id", "rank", "score")
