"""Approximate nearest neighbours by adaptive dimension scan.

Vectors lie in lists around centroids. Within a probed list the scan goes through
blocks of columns of randomly rotated vectors. After each block the squared partial distance, scaled up to
all dimensions, is tested against the query's bound: if the hypothesis "this
vector is within the bound" is rejected, the candidate is abandoned. What survives
all blocks is scored exactly on the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.sampling import bounded_sample
from corpusmill.llm.stores import prepare, stored
from corpusmill.llm.vectors import chunked, matrix, unit, usable

FIT_ROWS = 8192       # rows on which lists, probes and first bounds are fitted
LIST_ROWS = 800       # mean length of a list, while there are fewer than MOST_LISTS
MOST_LISTS = 4096
BLOCK = 4096
QUERIES = 512
COLUMNS = 16          # dimensions between two tests
EPSILON = 2.1         # deviations at which a candidate is abandoned
SEED = 29


class Index:
    """Centroids, rotation and probe count, fitted on a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, rows: int, k: int, goal: float):
        rng = np.random.default_rng(SEED)
        order = np.argsort(ids, kind="stable")
        self.sample, self.ids = sample[order], ids[order]
        lists = int(min(MOST_LISTS, max(1, rows // LIST_ROWS), max(1, len(sample) // 8)))
        self.rotation = np.linalg.qr(rng.normal(size=(sample.shape[1],) * 2))[0]
        self.centroids = self._means(lists, rng)
        self.probes = self._calibrate(k, goal, rng)

    def _means(self, lists: int, rng: np.random.Generator) -> np.ndarray:
        c = self.sample[rng.choice(len(self.sample), lists, replace=False)]
        for _ in range(12):
            near = (self.sample @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, self.sample)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
        return c

    def _calibrate(self, k: int, goal: float, rng: np.random.Generator) -> int:
        """Lists to probe so that ``goal`` of the sample's own neighbours lie in them."""
        if len(self.centroids) == 1:
            return 1
        some = rng.choice(len(self.sample), min(512, len(self.sample)), replace=False)
        s = self.sample[some] @ self.sample.T
        s[np.arange(len(some)), some] = -2
        best = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
        home = (self.sample @ self.centroids.T).argmax(axis=1)
        rank = (-(self.sample[some] @ self.centroids.T)).argsort(axis=1).argsort(axis=1)
        need = np.take_along_axis(rank, home[best], axis=1) + 1
        return int(np.quantile(need, goal, method="higher"))

    def bounds(self, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """For each query the distance of its k-th neighbour in the sample: none farther is needed."""
        out = np.full(len(x), np.inf)
        if len(self.sample) > k:
            s = x @ self.sample.T
            s[ids[:, None] == self.ids[None, :]] = -2
            kth = np.partition(s, -k, axis=1)[:, -k]
            out = np.where(kth > -2, np.sqrt(np.maximum(2 - 2 * kth, 0)) + 1e-9, np.inf)
        return out


def scan(queries: np.ndarray, bounds: np.ndarray, rotated: np.ndarray) -> Iterator[np.ndarray]:
    """For each rotated query the candidates that no test abandons."""
    n, dim = rotated.shape
    blocks = [rotated[:, at:at + COLUMNS] for at in range(0, dim, COLUMNS)]
    for q, bound in zip(queries, bounds, strict=True):
        alive, partial = None, np.zeros(n)
        for number, block in enumerate(blocks):
            own = q[number * COLUMNS:(number + 1) * COLUMNS]
            diff = (block if alive is None else block[alive]) - own
            partial = (partial if alive is None else partial) + np.einsum("ij,ij->i", diff, diff)
            seen = min(dim, (number + 1) * COLUMNS)
            limit = bound if seen == dim else bound * (1 + EPSILON / np.sqrt(seen)) * np.sqrt(seen / dim)
            keep = np.flatnonzero(partial <= limit * limit)
            alive = keep if alive is None else alive[keep]
            partial = partial[keep]
            if not len(alive):
                break
        yield alive


def _scanner(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rotation = shared.value.rotation
        for batch in batches:
            for n, payload, m, asked in batch[["n", "payload", "m", "asked"]].itertuples(index=False):
                ids = np.frombuffer(payload, "<i8", n)
                raw = np.frombuffer(payload, "<f8", -1, 8 * n).reshape(n, -1)
                norm, rotated = np.linalg.norm(raw, axis=1), unit(raw) @ rotation
                q_ids, bounds = np.frombuffer(asked, "<i8", m), np.frombuffer(asked, "<f8", m, 8 * m)
                q_raw = np.frombuffer(asked, "<f8", -1, 16 * m).reshape(m, -1)
                out = []
                for own, x, found in zip(q_ids.tolist(), q_raw, scan(unit(q_raw) @ rotation, bounds, rotated), strict=True):
                    found = found[ids[found] != own]
                    if len(found):
                        score = raw[found] @ x / (norm[found] * np.linalg.norm(x))
                        best = np.lexsort((ids[found], -score))[:k]
                        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[found][best], "score": score[best]}))
                if out:
                    yield pd.concat(out)

    return run


def _pack_vectors(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id")
    payload = frame["vec_id"].to_numpy("<i8").tobytes() + matrix(frame["embedding"]).astype("<f8").tobytes()
    return pd.DataFrame({"list": [int(frame["list"].iloc[0])], "n": [len(frame)], "payload": [payload]})


def _pack_queries(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id")
    asked = (frame["vec_id"].to_numpy("<i8").tobytes() + frame["bound"].to_numpy("<f8").tobytes()
             + matrix(frame["embedding"]).astype("<f8").tobytes())
    return pd.DataFrame({"list": [int(frame["list"].iloc[0])], "m": [len(frame)], "asked": [asked]})


def search(vectors: DataFrame, is_query: Column, k: int = 5, goal: float = 0.97) -> DataFrame:
    """The ``k`` nearest rows found for each row where ``is_query`` holds, by largest cosine.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (the cosine, in double
    precision, on the vectors as they are); ties go to the smaller id. Rows of the
    query's own id are no candidates. Null, empty or zero vectors, such with null or
    non-finite components, and rows without an id take no part. Vectors of another
    length have no cosine with a query: each length is searched on its own, one after
    another. Of repeated ids each row is a candidate, and of those of a length the
    smallest vector is the query. No usable rows give no rows.

    Lists, probes and first bounds of a length are fitted on at most ``FIT_ROWS`` of its
    rows; every row is put in a list. ``goal`` is the share of neighbours that the probed lists should
    hold. A query for which fewer than ``k`` were found asks all lists again,
    without a bound. Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
                          F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = stored(rows, "vectors")
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.max("q").alias("asked")).where("asked").orderBy("d")
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in lengths.collect():  # the lengths that occur
        found = found.unionByName(_search(rows.where(F.size("embedding") == length["d"]), k, goal))
    return found


def _search(rows: DataFrame, k: int, goal: float) -> DataFrame:
    """``search`` over stored rows (vec_id, embedding, q) of one length."""
    spark = rows.sparkSession
    total = rows.count()
    sample = bounded_sample(rows.select("vec_id", "embedding"), ["vec_id", "embedding"], FIT_ROWS, SEED).toPandas()
    index = Index(unit(matrix(sample["embedding"])), sample["vec_id"].to_numpy(), total, k, goal)
    shared = spark.sparkContext.broadcast(index)  # FIT_ROWS vectors and MOST_LISTS centroids at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = (unit(matrix(batch["embedding"])) @ shared.value.centroids.T).argmax(axis=1)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "embedding": batch["embedding"], "list": near})

    placed = rows.select("vec_id", "embedding").mapInPandas(assign, "vec_id long, embedding array<double>, list int")
    lists = stored(chunked(placed, ["list"], F.xxhash64("vec_id", "embedding"), BLOCK).groupBy("list", "chunk")
                   .applyInPandas(_pack_vectors, "list int, n int, payload binary"), "lists")
    asked = rows.where("q").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def probe(every: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            count = len(index.centroids) if every else index.probes
            for batch in batches:
                for at in range(0, len(batch), QUERIES):
                    some = batch.iloc[at:at + QUERIES]
                    x, ids = unit(matrix(some["embedding"])), some["vec_id"].to_numpy()
                    near = (-(x @ index.centroids.T)).argsort(axis=1)[:, :count]
                    bound = np.full(len(some), np.inf) if every else index.bounds(x, ids, k)
                    yield pd.DataFrame({"vec_id": np.repeat(ids, count), "list": near.ravel(),
                                        "bound": np.repeat(bound, count),
                                        "embedding": some["embedding"].repeat(count).array})

        return run

    def ask(queries: DataFrame, every: bool) -> DataFrame:
        wanted = queries.mapInPandas(probe(every), "vec_id long, list int, bound double, embedding array<double>")
        packed = (chunked(wanted, ["list"], F.xxhash64("vec_id"), QUERIES).groupBy("list", "chunk")
                  .applyInPandas(_pack_queries, "list int, m int, asked binary"))
        found = lists.join(packed, "list").mapInPandas(_scanner(shared, k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = stored(ask(asked, False), "found")
    few = first.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1)).select(
        F.col("query_id").alias("vec_id"))
    again = stored(asked.join(few, "vec_id", "left_anti"), "again")
    if not again.isEmpty():
        second = ask(again, True)
        first = first.join(again.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(second)
    return first.select("query_id", "rank", "vec_id", "score")
