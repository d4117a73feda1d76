"""Exact nearest-neighbour search.

The corpus never moves: each task multiplies its Arrow batches with the question
vectors and hands on its own best k per question, so the exchange carries
``k x questions`` rows per partition whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.vectors import binarise, hamming_score, l2_normalise
from corpusmill.operators.lineage import checkpointed
from corpusmill.operators.topk import top_k

# Question sets up to this size travel with the task; larger ones are joined block by block.
MAX_SHIPPED_QUESTIONS = 2_000
BLOCK_ROWS = 20_000
MAX_SHIPPED_HITS = 500_000
# Fixed value: keeps a spread of scores from dividing by zero.
SCORE_GUARD = 1e-6


def _distances(kind: str, questions: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Distance of every question (rows) to every vector (columns)."""
    if kind == "hamming":
        # unsigned, because the bit count of a negative number is that of its absolute value
        questions, vectors = questions.view(np.uint64), vectors.view(np.uint64)
        out = np.zeros((len(questions), len(vectors)))
        for word in range(questions.shape[1]):
            out += np.bitwise_count(questions[:, word, None] ^ vectors[None, :, word])
        return out
    dots = questions @ vectors.T
    if kind == "cosine":
        return 1.0 - dots
    return (questions ** 2).sum(1)[:, None] + (vectors ** 2).sum(1)[None, :] - 2.0 * dots


def _matrix(kind: str, column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.int64 if kind == "hamming" else np.float64)


def _best(kind: str, k: int, q_ids: np.ndarray, questions: np.ndarray, ids: np.ndarray,
          vectors: np.ndarray) -> pd.DataFrame:
    """Best k per question, ties by id."""
    dist = _distances(kind, questions, vectors)
    parts = []
    for row, q_id in enumerate(q_ids):
        d = dist[row]
        if len(d) > k:
            # everything as close as the k-th, so that ties are settled by id and not by position
            chosen = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        else:
            chosen = np.arange(len(d))
        order = np.lexsort((ids[chosen], d[chosen]))[:k]
        chosen = chosen[order]
        parts.append(pd.DataFrame({"query_id": q_id, "chunk_id": ids[chosen], "distance": d[chosen]}))
    return pd.concat(parts, ignore_index=True)


def _schema(corpus: DataFrame, id_col: str, questions: DataFrame) -> str:
    return (f"query_id {questions.schema['query_id'].dataType.simpleString()}, "
            f"chunk_id {corpus.schema[id_col].dataType.simpleString()}, distance double")


def nearest(corpus: DataFrame, questions: DataFrame, k: int, kind: str = "cosine", id_col: str = "chunk_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, distance, rank) of the ``k`` closest chunks per question.

    ``questions`` holds query_id and ``vector``. ``kind`` is cosine, l2 (squared)
    or hamming (packed bits). Fewer than ``k`` chunks give what there is.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    if kind not in ("cosine", "l2", "hamming"):
        raise ValueError(f"unknown distance {kind!r}")
    asked = questions.select("query_id", F.col(vector).alias("_v"))
    stored = corpus.select(F.col(id_col).alias("chunk_id"), F.col(vector).alias("_v"))
    schema = _schema(corpus, id_col, questions)
    local = asked.limit(MAX_SHIPPED_QUESTIONS + 1).toPandas()
    if len(local) <= MAX_SHIPPED_QUESTIONS:
        candidates = _scan(stored, local.sort_values("query_id", ignore_index=True), k, kind, schema)
    else:
        candidates = _blocks(stored, asked, k, kind, schema)
    return top_k(candidates, ["query_id"], [F.col("distance"), F.col("chunk_id")], k, salt_on="chunk_id")


def _scan(stored: DataFrame, local: pd.DataFrame, k: int, kind: str, schema: str) -> DataFrame:
    empty = local.empty
    q_ids = local["query_id"].to_numpy()
    q_vectors = None if empty else _matrix(kind, local["_v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for batch in batches:
            if empty or batch.empty:
                continue
            found = _best(kind, k, q_ids, q_vectors, batch["chunk_id"].to_numpy(), _matrix(kind, batch["_v"]))
            if best is not None:
                found = pd.concat([best, found], ignore_index=True)
                found = found.sort_values(["query_id", "distance", "chunk_id"]).groupby("query_id").head(k)
            best = found
        if best is not None:
            yield best

    return stored.mapInPandas(run, schema)


def _blocks(stored: DataFrame, asked: DataFrame, k: int, kind: str, schema: str) -> DataFrame:
    """Both sides cut into blocks of bounded size; every pair of blocks is one task's work."""
    n_stored = max(1, -(-stored.count() // BLOCK_ROWS))
    n_asked = max(1, -(-asked.count() // MAX_SHIPPED_QUESTIONS))
    left = (stored.withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.lit(n_stored)))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))))
    right = (asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).cast("int"))
             .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_stored - 1).cast("bigint")))))

    def run(chunks: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if chunks.empty or questions.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})
        return _best(kind, k, questions["query_id"].to_numpy(), _matrix(kind, questions["_v"]),
                     chunks["chunk_id"].to_numpy(), _matrix(kind, chunks["_v"]))

    return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(run, schema)


def with_score(hits: DataFrame, kind: str = "cosine", n_bits: int | None = None) -> DataFrame:
    """Relevance score of each hit: cosine less one half, or one less the share of differing bits."""
    distance = F.col("distance")
    if kind == "hamming":
        if not n_bits:
            raise ValueError("the Hamming score needs the number of bits")
        score: Column = hamming_score(distance, F.lit(n_bits))
    elif kind == "l2":
        score = 1 - (1 + distance) / 2
    else:
        # on unit vectors the squared L2 distance is 2 (1 - cos)
        score = 1 - (1 + 2 * distance) / 2
    return hits.withColumn("score", score)


def hits_with(hits: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Columns of a large table for the hits of a search, which must be stored already.

    Their number is read back: below the bound they are shipped to the table's
    partitions, so the table is filtered where it lies; above it, the join is
    left to the optimizer.
    """
    small = hits.count() <= MAX_SHIPPED_HITS
    return table.join(F.broadcast(hits) if small else hits, on)


def search(corpus: DataFrame, questions: DataFrame, k: int, threshold: float | None = -0.5,
           id_col: str = "chunk_id") -> DataFrame:
    """Cosine search with the threshold applied after the cut to k, where it costs k rows per question."""
    unit_c = corpus.select(id_col, l2_normalise(F.col("embedding")).alias("embedding"))
    unit_q = questions.select("query_id", l2_normalise(F.col("embedding")).alias("embedding"))
    hits = with_score(nearest(unit_c, unit_q, k, "cosine", id_col))
    return hits if threshold is None else hits.filter(F.round("score", 9) >= threshold)


def search_bits(corpus: DataFrame, questions: DataFrame, k: int, n_bits: int, max_distance: int | None = None,
                id_col: str = "chunk_id") -> DataFrame:
    """Hamming search over sign bits."""
    bits_c = corpus.select(id_col, binarise(F.col("embedding")).alias("embedding"))
    bits_q = questions.select("query_id", binarise(F.col("embedding")).alias("embedding"))
    hits = with_score(nearest(bits_c, bits_q, k, "hamming", id_col), "hamming", n_bits)
    return hits if max_distance is None else hits.filter(F.col("distance") <= max_distance)


def search_filtered(corpus: DataFrame, questions: DataFrame, allowed: DataFrame, k: int, fetch_k: int,
                    id_col: str = "chunk_id") -> DataFrame:
    """Search ``fetch_k``, keep the hits that ``allowed`` lists (each id once), cut to ``k``."""
    hits = checkpointed(search(corpus, questions, fetch_k, threshold=None, id_col=id_col).drop("rank"))
    kept = hits_with(hits, allowed.select(F.col(id_col).alias("chunk_id")), "chunk_id")
    return top_k(kept, ["query_id"], [F.col("distance"), F.col("chunk_id")], k)


def minmax_hits(corpus: DataFrame, questions: DataFrame, k: int, threshold: float, id_col: str = "chunk_id") -> DataFrame:
    """Best k by dot product, scored by where the product lies between the corpus's extremes.

    The extremes need one pass that keeps two numbers per question and partition.
    """
    unit_c = corpus.select(F.col(id_col).alias("chunk_id"), l2_normalise(F.col("embedding")).alias("embedding"))
    unit_q = questions.select("query_id", l2_normalise(F.col("embedding")).alias("embedding"))
    negated = unit_q.select("query_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    top = nearest(unit_c, unit_q, k, "cosine")
    high = top.filter(F.col("rank") == 1).select("query_id", (1 - F.col("distance")).alias("high"))
    low = nearest(unit_c, negated, 1, "cosine").select("query_id", (F.col("distance") - 1).alias("low"))
    scored = (top.join(high, "query_id").join(low, "query_id")
              .withColumn("score", (1 - F.col("distance") - F.col("low")) / (F.col("high") - F.col("low") + SCORE_GUARD)))
    return scored.filter(F.round("score", 9) >= threshold).select("query_id", "chunk_id", "rank", "score")
