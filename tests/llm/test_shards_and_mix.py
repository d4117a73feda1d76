"""Sharding and mixing: laws, groups, quotas, odd inputs."""

import itertools
import re
import zlib

import pytest
from corpusmill.llm import mixing, sharding
from corpusmill.llm.catalog import QUERIES
from helpers import documents
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def check_shards(rows, texts, shards):
    sizes = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)}
    assert sum(map(len, sizes.values())) == len(rows) == len(texts)
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(v == list(range(len(v))) for v in sizes.values())
    want = sorted(((d is not None, d or 0, len((t or "").encode()) + 16, -1 if t is None else zlib.crc32(t.encode()))
                   for d, t in texts))
    assert want == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"],
                           -1 if r["text_crc32"] is None else r["text_crc32"]) for r in rows)
    assert {r["law"] for r in rows} <= {"rows"} and all(r["grown_shard"] is None for r in rows)


def test_op3(spark):
    rows = QUERIES["op3_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_shards(rows, list(docs.items()), 40)
    groups = {}
    for r in rows:
        groups.setdefault(docs[r["doc_id"]], []).append(r["shard"])
    copied = [g for g in groups.values() if len(g) > 1]
    assert copied and sum(len(set(g)) > 1 for g in copied) <= 0.05 * len(copied)


def test_large_group_fills_few_shards(spark):
    texts = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(900)]
    rows = sharding.shard(documents(spark, texts).withColumn("shard", F.lit("clash")), shards=9).collect()
    check_shards(rows, texts, 9)
    assert len({r["shard"] for r in rows if r["size"] == 19}) <= 4


@pytest.mark.parametrize("texts, least, cut", [
    ([(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(4003)], 14, 1),  # a third of all rows share a text
    ([(i, f"text {i // 2}") for i in range(4003)], 1, 40),  # every text occurs twice
    ([(i, f"text {i % 110}") for i in range(4003)], 1, 40)])  # groups of a third of a shard, no row without links
def test_groups_are_cut_as_little_as_can_be(spark, texts, least, cut):
    rows = sharding.shard(documents(spark, texts), shards=40).collect()
    check_shards(rows, texts, 40)
    texts, groups = dict(texts), {}
    for r in rows:
        groups.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert max(map(len, groups.values())) <= max(least, 3)
    assert sum(len(g) > 1 for g in groups.values()) <= cut


def test_fill():
    assert sharding.fill([("a", 3), ("b", 5)], {0: 4, 1: 5}) == [("b", 0, 5, 1), ("a", 0, 3, 0)]
    assert sharding.fill([("a", 9), ("b", 1)], {0: 4, 1: 4, 2: 2}) == [("a", 0, 4, 0), ("a", 4, 8, 1), ("a", 8, 9, 2),
                                                                       ("b", 0, 1, 2)]
    assert sharding.fill([], {}) == []


@pytest.mark.parametrize("texts", [[], [(1, None)], [(1, ""), (1, ""), (None, None), (None, "a"), (2, "x" * 100_000)],
                                   [(i, "same") for i in range(50)]])
def test_odd_shards(spark, texts):
    check_shards(sharding.shard(documents(spark, texts), shards=4).collect(), texts, 4)


def test_op7(spark):
    rows = QUERIES["op7_mixing"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size, taken, target = {}, {}, {}
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(WORDS.findall(docs[r["doc_id"]]["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[source] = size.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == size[docs[r["doc_id"]]["source"]]
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = dict(zip(names, mixing.quotas([size[s] for s in names], [weight[s] for s in names],
                                         sum(size.values()), 3), strict=True))
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    again = QUERIES["op7_mixing"](spark, SF).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}


def test_quotas():
    assert mixing.quotas([10, 10, 80], [5, 2, 1], 100, 3) == [30, 30, 40]
    assert mixing.quotas([0, 5], [1, 1], 5, 3) == [0, 5]
    assert mixing.quotas([], [], 0, 3) == []
    got = mixing.quotas([1, 100, 100, 1000], [5, 2, 1, 5], 1201, 3)
    assert got[0] == 3 and got[1] == 299.5 and abs(sum(got) - 1201) < 1e-9


def brute_cost(patterns, wanted, repeats):
    """The most words that can be routed, and the least cost of routing them, by trying all flows."""
    arcs = [(p, s) for p, (sources, _) in enumerate(patterns) for s in sources]
    best = (0, 0)
    top = [repeats * patterns[p][1] for p, _ in arcs]
    for flow in itertools.product(*(range(t + 1) for t in top)):
        out, into = [0] * len(patterns), [0] * len(wanted)
        for (p, s), f in zip(arcs, flow, strict=True):
            out[p] += f
            into[s] += f
        if all(o <= repeats * w for o, (_, w) in zip(out, patterns, strict=True)) and all(
                i <= w for i, w in zip(into, wanted, strict=True)):
            cost = sum(k * min(max(o - (k - 1) * w, 0), w) for o, (_, w) in zip(out, patterns, strict=True)
                       for k in range(1, repeats + 1))
            best = max(best, (sum(flow), -cost))
    return best


@pytest.mark.parametrize("patterns, wanted", [
    ([([0], 2), ([0, 1], 2), ([1], 1)], [3, 4]), ([([0, 1], 1), ([1, 2], 2), ([0, 2], 1)], [2, 2, 3]),
    ([([0], 1), ([0, 1], 3)], [6, 1]), ([([0], 0), ([0, 1], 1)], [5, 5])])
def test_route_is_a_cheapest_flow(patterns, wanted):
    flow = mixing.route(patterns, wanted, 2)
    sent = [sum(f) for f in flow]
    cost = sum(k * min(max(o - (k - 1) * w, 0), w) for o, (_, w) in zip(sent, patterns, strict=True) for k in (1, 2))
    assert (sum(sent), -cost) == brute_cost(patterns, wanted, 2)


def test_odd_mix(spark):
    rows = [(1, None, None, "a"), (2, "", None, None), (3, "one two three", None, None), (3, "one two three", None, None),
            (None, "w " * 50_000, None, "b"), (5, "x y", None, ""), (6, "x", None, "a")]
    docs = documents(spark, rows).withColumn("mix_size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["mix_taken"] == r["mix_repeats"] * r["mix_size"] + r["mix_rest"] <= 3 * r["mix_size"]
        by.setdefault(r["source"], []).append(r)
    assert set(by) == {"a", "b", "", None}
    for group in by.values():
        assert abs(sum(r["mix_taken"] for r in group) - group[0]["mix_target"]) <= 1
    assert sum({r["source"]: r["mix_target"] for r in got}.values()) == pytest.approx(50_009)
    assert mixing.mix(documents(spark, [])).count() == 0


def test_overlapping_sources(spark):
    docs = documents(spark, [(i, "w " * 10, None, None) for i in range(30)])
    names = F.when(F.col("doc_id") < 10, F.array(F.lit("a"))).when(
        F.col("doc_id") < 20, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b")))
    got = mixing.mix(docs, sources=names, cycle=(1, 1), share=1.0).collect()
    assert sum(r["mix_taken"] for r in got) == 300 and all(r["mix_taken"] == 10 for r in got)


def test_repeated_rows_share_alike(spark):
    """5,000 equal rows without an id: their source's taken words come near its target all the same."""
    rows = [(None, "one two three four", None, "a")] * 5000 + [(i, "w " * 7, None, "b") for i in range(300)]
    got = mixing.mix(documents(spark, rows)).collect()
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["mix_taken"] for r in mine) - mine[0]["mix_target"]) <= len(mine)
        assert all(r["mix_taken"] == r["mix_repeats"] * r["mix_size"] + r["mix_rest"] <= 3 * r["mix_size"] for r in mine)
    assert len({r["mix_taken"] for r in got if r["source"] == "a"}) == 1


def test_a_hundred_thousand_sources(spark):
    """Quotas of single sources need no flow and no driver: sizes from 1 to 40 words, against the plain rule."""
    n = 100_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 40 + 1).cast("int")).alias("text"),
                                 F.format_string("s%06d", "id").alias("source"))
    got = mixing.mix(docs).select("doc_id", "mix_size", "mix_target", "mix_taken").toPandas().sort_values("doc_id")
    sizes = [i * 7919 % 40 + 1 for i in range(n)]
    want = mixing.quotas(sizes, [(5, 2, 1)[i % 3] for i in range(n)], sum(sizes), 3)
    assert got["mix_size"].tolist() == sizes
    assert max(abs(a - b) for a, b in zip(got["mix_target"], want, strict=True)) < 1e-6
    assert (abs(got["mix_taken"] - got["mix_target"]) <= 0.5 + 1e-6).all()
