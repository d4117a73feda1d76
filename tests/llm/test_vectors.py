"""Vector operators against brute force."""

import math

import numpy as np
import pytest
from corpusmill.llm import ann, covertree
from corpusmill.llm.catalog import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, "f8"), np.array(b, "f8")
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def brute_links(rows, threshold):
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, v, la) in enumerate(rows):
        for j in range(i):
            _, u, lb = rows[j]
            if la is not None and la == lb and usable(v) and usable(u) and len(u) == len(v) and cosine(u, v) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, links[i], least[root(i)], d == least[root(i)]) for i, (d, _, _) in enumerate(rows)), key=str)


def near(spark, rows, threshold=0.93):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("x")).withColumn("rid", F.lit(0))
    got = covertree.near_vectors(table, threshold).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(400):
        v = base[rng.integers(60)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3, 0.6])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    want = brute_links(rows, 0.93)
    assert near(spark, rows) == want and sum(k for _, _, _, k in want) < len(rows)


def test_odd_vectors(spark):
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [NAN, 1.0], 0), (5, [INF, 1.0], 0), (6, [None, 1.0], 0),
            (7, [1.0, 0.0], 0), (8, [2.0, 0.0], 0), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 0),
            (7, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (None, [0.0, 1.0], 0), (12, [1e30, 1e29], 0)]
    assert near(spark, rows) == brute_links(rows, 0.93)
    assert near(spark, []) == []


def test_op9(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op9_near_vectors"](spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_links(rows, 0.93)


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:] = x[rng.integers(0, 40, 200)] + rng.normal(size=(200, 8)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    levels = covertree.build(x)
    for depth, (net, radii, node) in enumerate(levels):
        d = np.linalg.norm(x - x[net[node]], axis=1)
        assert (d <= radii[node] + 1e-9).all()
        if depth:
            up_net, _, up = levels[depth - 1]
            assert set(up_net) <= set(net)                         # nested
            assert (up == up[net[node]]).all()                     # an ancestor of the node is the vector's ancestor
    i, j = covertree.traverse(x, levels, x, levels, 0.3)
    apart = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert {(a, b) for a, b in zip(*np.nonzero(apart <= 0.3), strict=True)} <= set(zip(i, j, strict=True))
    assert len(i) < 0.5 * len(x) ** 2


def brute_search(rows, k, every):
    good = [(i, v) for i, v, *_ in rows if i is not None and usable(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            out[q] = sorted(((-cosine(v, u), i) for i, u in good if i != q))[:k]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_op1_recall(spark, name):
    sf = f"/root/testdata/{name}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], "f8")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = found(QUERIES["op1_ann"](spark, sf).collect())
    hit = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[ids == q][0]
        s[ids == q] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]])
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert [(-c, i) for _, i, c in got[q]] == sorted((-c, i) for _, i, c in got[q])
        for _, i, c in got[q]:
            assert abs(c - cosine(x[ids == q][0], x[ids == i][0])) < 1e-12
        hit += len(best & {i for _, i, _ in got[q]})
    assert hit >= 0.9 * 5 * len(got) and len(got) == (ids % 50 == 0).sum()


def test_lists_and_tests_find_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=32)], 0) for i in range(1500)]
    got = found(ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect())
    want = brute_search(rows, 5, 20)
    hit = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hit >= 0.9 * 5 * len(want)
    assert all(len(v) == 5 for v in got.values())


def test_odd_search(spark):
    rows = [(0, [1.0, 0.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [NAN, 1.0], 0), (4, [1.0, 1.0], 0), (5, [1.0, 1.0], 1),
            (6, [-1.0, 0.0], None), (None, [1.0, 0.0], 0), (7, [1.0], 0), (8, [None, 1.0], 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("q", F.lit(1))
    got = found(ann.search(table, F.col("vec_id") % 5 == 0).collect())
    assert [i for _, i, _ in got[0]] == [4, 5, 6] and [i for _, i, _ in got[5]] == [4, 0, 6]
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0
    assert ann.search(spark.createDataFrame(rows[1:3], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0


def test_each_length_is_searched(spark):
    """Vectors of a rare length are found by queries of that length."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8 if i % 10 else 3).tolist()) for i in range(300)]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, k=3)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 300, 50):
        x = np.array(rows[q][1])
        others = [(-(x @ np.array(v)) / np.linalg.norm(x) / np.linalg.norm(v), i) for i, v in rows if len(v) == len(x) and i != q]
        assert [v for _, v in sorted(found[q])] == [i for _, i in sorted(others)[:3]]


def test_one_hot_vector_id(spark):
    """60,000 rows without a sampled bound broken: repeated ids do not crowd the driver."""
    rows = spark.range(30_000).select(F.lit(7).cast("bigint").alias("vec_id"), F.array(
        F.rand(1), F.rand(2), F.rand(3)).alias("embedding")).union(spark.range(3).select(
            F.col("id") + 100, F.array(F.lit(1.0), F.col("id") / 10, F.lit(0.0))))
    got = ann.search(rows, F.col("vec_id") == 100, k=2).collect()
    assert [r["rank"] for r in got] == [1, 2] and got[0]["vec_id"] in (7, 101)
