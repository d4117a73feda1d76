"""The Jaccard join against brute force, and the bounds it rests on."""

import random
from collections import defaultdict
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest
from corpusmill.llm import jaccard
from corpusmill.llm.catalog import QUERIES
from corpusmill.llm.graph import components
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

RULE = jaccard.Rule()


def plain_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """(doc_id, set size, smallest id reached) of each row, by shared shingles."""
    sets, where, parent = [plain_set(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for e in s:
            for j in where[e]:
                common[j] += 1
            where[e].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, parts=3):
    docs = documents(spark, rows).repartition(parts).withColumn("class", F.lit("x")).withColumn("n", F.lit(1))
    got = jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in got), key=str)


def corpus(seed, groups=25, copies=4, passage=40):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    common = [word() for _ in range(passage)]
    rows = []
    for _ in range(groups):
        size = rng.choice([3, 8, 20, 60, 150, 400])
        base = [word() for _ in range(size)]
        if rng.random() < 0.5:
            at = rng.randrange(len(base) + 1)
            base[at:at] = common
        for _ in range(rng.randrange(1, copies + 1)):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(text) // 18) + 1)):
                k = rng.randrange(len(text))
                text[k:k + rng.randrange(2)] = [word() for _ in range(rng.randrange(2))]
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({c for _, _, c in want}) < len(rows)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One  two"), (5, "one\ttwo"), (6, "ONE TWO three"), (7, "École une"),
            (8, "école une"), (9, long), (10, long + " end"), (11, "a b c d e"), (11, "a b c d e"), (None, "a b c d e"),
            (None, "n u l l o n l y x"), (None, "n u l l o n l y x"), (None, " ".join("n u l l o n l y x".split() + ["y"]))]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


def test_many_classes_of_one_block(spark, monkeypatch):
    """Stars and what they leave over: a group and a passage far above the limit for all pairs."""
    monkeypatch.setattr(jaccard, "FEW", 3)
    rng = random.Random(7)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(1, 6)):
            text[rng.randrange(80)] = f"x{i}_{rng.randrange(99)}"
        rows.append((i, " ".join(text)))
    for i in range(60, 120):
        rows.append((i, " ".join(base[:40] + [f"y{i}_{k}" for k in range(20)])))
    assert run(spark, rows, parts=4) == brute(rows)


def test_op6(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op6_jaccard"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 2**32))
def test_linked_sets_share_a_key(common, left, right, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 2**63, common + left + right, dtype="u8") * np.uint64(2))
    rng.shuffle(h)
    a, b = np.sort(np.concatenate([h[:common], h[common:common + left]])), np.sort(
        np.concatenate([h[:common], h[common + left:]]))
    flag = lambda s: s % np.uint64(7) < 3
    if RULE.links(len(np.intersect1d(a, b)), len(a), len(b)):
        assert len(a) + len(b) - 2 * len(np.intersect1d(a, b)) <= RULE.differ(len(a), len(b))
        assert len(np.intersect1d(jaccard.block_keys(a, flag(a), RULE), jaccard.block_keys(b, flag(b), RULE)))
    x, y = (np.frombuffer(jaccard.bit_sketch(s), "<u8") for s in (a, b))
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(jaccard.fold(x, size) ^ jaccard.fold(y, size)).sum())
    assert apart <= len(np.setxor1d(a, b))


def test_frequent_hashes_are_kept(monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 50)
    monkeypatch.setattr(jaccard, "CHUNK", 500)
    rng, found = np.random.default_rng(3), jaccard._Frequent()
    total = 0
    for i in range(2000):
        s = np.unique(np.append(rng.integers(0, 2**60, 20, dtype="u8"), np.uint64(i % 3)))
        found.add(s)
        total += len(s)
    found.merge()
    assert {0, 1, 2} <= set(found.hashes.tolist()) and len(found.hashes) <= 50


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, **{i: 300 for i in range(300, 340)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_class_is_one_entry_of_a_block(monkeypatch):
    """Copies of X beside a near copy Y, and Z elsewhere that links with Y only, once tasks forget classes."""
    steps, docs = [], MagicMock()
    docs.select.return_value = docs.where.return_value = docs.groupBy.return_value = docs
    docs.mapInPandas.side_effect = docs.applyInPandas.side_effect = lambda step, _: steps.append(step) or docs
    docs.sparkSession.sparkContext.broadcast = lambda value: MagicMock(value=value)
    context = MagicMock()
    context.get.return_value.partitionId.return_value = 0
    for name, value in (("SEEN", 0), ("F", MagicMock()), ("TaskContext", context), ("stored", lambda df, _: df)):
        monkeypatch.setattr(jaccard, name, value)
    first, second = [], []
    for group in range(20):
        words = [f"g{group}w{i}" for i in range(45)]
        first += [" ".join(words)] * 70 + [" ".join(words[1:])]
        second.append(" ".join(words[11:]))
    jaccard.candidates(docs, np.unique(np.concatenate([jaccard.shingles(t) for t in first])), 1000, RULE)
    emit, meet = steps
    sent = pd.concat([f for texts in (first, second) for f in emit(iter([pd.DataFrame({"text": texts})]))])
    met = meet(sent.reset_index(drop=True))
    a, b = jaccard._unpacked(met[met["kind"] == 1])
    pairs = set(zip(a.view("i8").tolist(), b.tolist(), strict=True))
    names = [sorted(jaccard.class_of(jaccard.shingles(t)) for t in both) for both in zip(first[70::71], second, strict=True)]
    assert {tuple(n) for n in names} <= pairs
