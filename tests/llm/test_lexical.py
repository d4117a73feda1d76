"""Block-Max MaxScore against a plain ranking."""

import math
import re

import numpy as np
import pytest
from corpusmill.llm import lexical
from helpers import ODD_ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """(item, rank, doc, score), rows of equal score by id, null last."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t in set(terms(text))
                   if (df := sum(t in words for _, words in held))}
        for d, words in held:
            m = 100 - 50 + (50 * len(words) * n_docs) // n_terms
            s = sum(w * (1_000_000_000 * words.count(t) // (1000 * words.count(t) + 20 * m)) for t, w in weights.items())
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


ITEMS = [(1, "the cat; THE Mat on"), (2, None), (3, "..."), (4, "naïve 漢字 word"), (4, "same text"), (5, "x" * 5000),
         (1, "the cat; THE Mat on"), (None, "same id here"), (6, "nowhere")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_rank(spark, k, monkeypatch):
    docs = documents(spark, ODD_ROWS).repartition(3).withColumn("term", F.lit("x")).withColumn("rank", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("score", F.lit(7))
    got = [tuple(r) for r in lexical.rank(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=key) == sorted(plain(ODD_ROWS, ITEMS, k), key=key)


def test_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.rank(documents(spark, []), items).count() == 0
    assert lexical.rank(documents(spark, ODD_ROWS), items.limit(0)).count() == 0


def vocabulary(rng, n):
    return [f"w{i}" for i in np.minimum((rng.pareto(0.7, n)).astype(int), 400)]


def test_shards_windows_and_blocks(spark, monkeypatch):
    """Long lists, many blocks: bounds must not lose a document."""
    rng = np.random.default_rng(3)
    docs = [(int(rng.integers(0, 10**6)), " ".join(vocabulary(rng, rng.integers(1, 60)))) for _ in range(3000)]
    docs += [(7, docs[0][1])] * 40 + [(10**7, "w1 " * 400), (10**7 + 1, "w5 " * 70_000)]
    items = [(i, " ".join(vocabulary(rng, 12))) for i in range(150)]
    got = [tuple(r) for r in lexical.rank(documents(spark, docs).repartition(4), spark.createDataFrame(
        items, "item_id bigint, text string"), 10).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(plain(docs, items, 10))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 8), st.sampled_from([16, 100, 4096]))
def test_best_of_shard(seed, k, window):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 700))
    m = rng.integers(50, 2000, n)
    ids = rng.permutation(n)
    sums, lists = np.zeros(n, "i8"), []
    for _ in range(int(rng.integers(1, 9))):
        docs = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.2, 0.9]))
        if not len(docs):
            continue
        tf = rng.choice([1, 2, 300, 70_000], len(docs), p=[0.6, 0.3, 0.08, 0.02])
        weight = int(rng.integers(0, 5000))
        payload, df = lexical.pack(docs, tf, lexical.impact(tf, m[docs]), np.array([0]))
        lists.append((weight, lexical.Postings(payload[0], int(df[0]), m)))
        at, worth = lists[-1][1].between(0, n)
        assert at.tolist() == docs.tolist() and worth.tolist() == lexical.impact(tf, m[docs]).tolist()
        sums[docs] += weight * worth
    got = sorted(zip(*(a.tolist() for a in lexical.best_of_shard(lists, ids, k, window)), strict=True))
    want = sorted(np.flatnonzero(sums > 0).tolist(), key=lambda d: (-sums[d], ids[d]))[:k]
    assert got == sorted((d, int(sums[d])) for d in want)


def test_blocks_are_rejected_unopened():
    """A rare term and a common one that is frequent in one block: most blocks of the common one stay packed."""
    n, m = 20_000, np.full(20_000, 100)
    rare, common = np.arange(0, n, 100), np.arange(n)
    tf_rare, tf_common = np.where(rare % 5000 == 0, 50, 1), np.where(common < 100, 300, 1)
    lists = [(w, lexical.Postings(lexical.pack(d, t, lexical.impact(t, m[d]), np.array([0]))[0][0], len(d), m))
             for w, d, t in ((6000, rare, tf_rare), (3000, common, tf_common))]
    seen = {}
    lexical.best_of_shard(lists, np.arange(n), 1, 1000, seen)
    assert seen["rejected"] > 0 and len(lists[1][1].unpacked) < len(lists[1][1].head) / 2


def test_long_lists_of_several_terms():
    """``pack`` with many lists at once."""
    rng = np.random.default_rng(5)
    parts = [np.sort(rng.choice(30_000, int(rng.integers(1, 900)), replace=False)) for _ in range(50)]
    tf = [rng.integers(1, 400, len(p)) for p in parts]
    m = rng.integers(50, 900, 30_000)
    doc, counts = np.concatenate(parts), np.concatenate(tf)
    payloads, df = lexical.pack(doc, counts, lexical.impact(counts, m[doc]), np.cumsum([0] + [len(p) for p in parts])[:-1])
    for p, t, raw, n in zip(parts, tf, payloads, df, strict=True):
        at, worth = lexical.Postings(raw, int(n), m).between(0, 30_000)
        assert at.tolist() == p.tolist() and worth.tolist() == lexical.impact(t, m[p]).tolist()
