import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.operators import (accounting, batching, containment, dedup, filters, models, names, ordered, retrieval,
                                  search, similar, splitting, store, tree)
from corpusmill.operators.labels import shortest_suffixes


def vectors_of(n, width=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, id_col="chunk_id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{id_col} long, embedding array<double>")


# filters

@pytest.mark.parametrize("rules", [["+the"], ["-the"], ["+The"], ["+.*x$"], ["+a|b", "-.*d"]])
def test_content_filter_follows_python_match(spark, rules):
    texts = ["the cat", "The cat", "a\nx", "ax", "bd", "", "b cd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["t"] for r in df.filter(filters.content_predicate(rules, F.col("t"))).collect()]

    def keep(t):
        hits = [(r[0], re.compile(r[1:], re.I if r[1:] == r[1:].lower() else 0).match(t)) for r in rules]
        return all(h for s, h in hits if s == "+") and not any(h for s, h in hits if s == "-")

    assert got == [t for t in texts if keep(t)]


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, {"lang": "en", "Note": "x"}), (2, {"lang": "fr"}), (3, {}), (4, {"other": "en"})], "id int, metadata map<string,string>")

    def ids(*rules):
        return [r["id"] for r in df.filter(filters.metadata_predicate(list(rules), F.col("metadata"))).collect()]

    assert ids("k+lang") == [1, 2] and ids("k-lang") == [3, 4] and ids("v+en") == [1, 4] and ids("v-en") == [2, 3]
    assert ids("b+lang:en") == [1]
    assert ids("b-lang:en") == [2]          # rows without the key go as well
    assert ids("k+note") == [1] and ids("k+NOTE") == []
    with pytest.raises(ValueError):
        filters.check_metadata_rules(df, ["k+absent"])
    for bad in ("x+a", "k*a", "k+", "b+nokey", "b+:v"):
        with pytest.raises(ValueError):
            filters.parse_metadata_rules([bad])
    with pytest.raises(ValueError):
        filters.parse_metadata_rules(["b+a:x", "b+a:y"])


def test_useless_path_rules(spark):
    df = spark.createDataFrame([("a/x.txt",), ("b/y.md",)], "path string")
    assert filters.useless_path_rules(df, "path", ["."], ["zzz"]) == ["include", "zzz"]
    assert filters.useless_path_rules(df, "path", ["txt"], ["md"]) == ["md"]


# sequences

def test_running_total_and_positions(spark):
    rows = [(k, i, (i * 7) % 5) for k in (0, 1) for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    out = ordered.running_total(df, ["k"], ["i"], F.floor(F.col("i") / 10), F.col("v"), "s", include_self=False)
    out = ordered.number_rows(out, ["k"], ["i"], F.floor(F.col("i") / 10), "pos")
    total = {0: 0, 1: 0}
    for n, r in enumerate(out.orderBy("k", "i").collect()):
        assert r["s"] == total[r["k"]] and r["pos"] == n % 100 + 1
        total[r["k"]] += r["v"]
    linked = ordered.with_previous(out, ["k"], "pos", "v", "before").orderBy("k", "i").collect()
    assert linked[0]["before"] is None and linked[1]["before"] == linked[0]["v"]


# chunks

@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(20, 60), st.integers(0, 19))
def test_cuts(sizes, limit, overlap):
    """Against the rule spelled out unit by unit."""
    want, held, first = [], [], 0
    for i, size in enumerate(sizes):
        if held and sum(sizes[j] for j in held) + size > limit:
            want.append((held[0], held[-1] + 1))
            kept = []
            for j in reversed(held):
                if sum(sizes[x] for x in kept) + sizes[j] > overlap:
                    break
                kept.insert(0, j)
            held = kept
        held = [*held, i]
    want.append((held[0], held[-1] + 1))
    got = splitting.cuts(np.array(sizes), limit, overlap)
    assert got == want
    assert {i for a, b in got for i in range(a, b)} == set(range(len(sizes)))


def test_pack_and_sizes(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb\n\ncccc\ndddd"), (2, "")], "doc_id int, text string")
    rows = splitting.pack(df, 3, 1).orderBy("doc_id", "chunk_no").collect()
    assert [r["page_content"] for r in rows] == ["aaaa bbbb", "cccc dddd"]
    assert splitting.chunk_size("query") == (3072, 500) and splitting.chunk_size("query", 50_000) == (5250, 500)
    assert splitting.chunk_size("summarize", 50_000) == (8000, 500) and splitting.chunk_size("recursive_summary") == (1024, 300)
    with pytest.raises(ValueError):
        splitting.pack(df, 3, 3)


# search

@pytest.mark.parametrize("kind", ["cosine", "l2", "hamming"])
def test_blocks_and_scan_agree(spark, monkeypatch, kind):
    x, q = vectors_of(60), vectors_of(7, seed=1)
    corpus, asked = frame(spark, x), frame(spark, q, "query_id")
    if kind == "hamming":
        corpus = corpus.withColumn("embedding", V.binarise(F.col("embedding")))
        asked = asked.withColumn("embedding", V.binarise(F.col("embedding")))

    def run():
        return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 9)) for r in search.nearest(corpus, asked, 5, kind).collect())

    scanned = run()
    monkeypatch.setattr(search, "MAX_SHIPPED_QUESTIONS", 3)
    monkeypatch.setattr(search, "BLOCK_ROWS", 17)
    assert run() == scanned
    if kind == "cosine":
        best = np.argsort(-(q @ x.T), axis=1)[:, :5]
        assert [c for _, _, c, _ in scanned] == best.ravel().tolist()


def test_identical_vectors_tie_by_id(spark):
    x = np.vstack([vectors_of(1)] * 6)
    hits = search.nearest(frame(spark, x), frame(spark, x[:1], "query_id"), 3).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits] == [0, 1, 2]
    with pytest.raises(ValueError):
        search.nearest(frame(spark, x), frame(spark, x[:1], "query_id"), 0)


def test_outlier_is_farthest(spark):
    base = np.ones(16)
    related = [base + 0.1 * v for v in np.random.default_rng(3).normal(size=(4, 16))]
    x = np.vstack([*related, -base])
    asked = frame(spark, [base], "query_id")
    for hits in (search.search(frame(spark, x), asked, 5, None), search.search_bits(frame(spark, x), asked, 5, 16)):
        far = {r["chunk_id"]: r["distance"] for r in hits.collect()}
        assert far[4] > max(far[i] for i in range(4))


def test_mmr_against_brute_force(spark):
    x, q = vectors_of(40), vectors_of(1, seed=5)
    rows = retrieval.diverse(frame(spark, x), frame(spark, q, "query_id"), 6, 20, 0.5).orderBy("pos").collect()
    near = list(np.argsort(-(x @ q[0]))[:20])
    chosen = [near.pop(0)]
    while len(chosen) < 6:
        gains = [0.5 * (x[i] @ q[0]) - 0.5 * max(x[i] @ x[j] for j in chosen) for i in near]
        chosen.append(near.pop(int(np.argmax(gains))))
    assert [r["chunk_id"] for r in rows] == chosen
    assert len(retrieval.diverse(frame(spark, x), frame(spark, q, "query_id"), 30, 10).collect()) == 10
    pure = retrieval.diverse(frame(spark, x), frame(spark, q, "query_id"), 6, 20, 1.0).orderBy("pos").collect()
    assert [r["chunk_id"] for r in pure] == list(np.argsort(-(x @ q[0]))[:6])


def test_svm_direction_is_a_minimum(spark):
    x, q = vectors_of(50), vectors_of(1, seed=9)[0]
    w = retrieval.exemplar_directions(frame(spark, x), q[None], len(x))[0][0]

    def loss(v):
        margin = np.maximum(0, 1 + x @ v[:-1] + v[-1]) ** 2
        own = max(0, 1 - q @ v[:-1] - v[-1]) ** 2
        return v @ v / 2 + 0.1 * (51 / 2 * own + 51 / 100 * margin.sum())

    rng = np.random.default_rng(0)
    assert all(loss(w) <= loss(w + 0.01 * rng.normal(size=len(w))) for _ in range(50))


def test_redundant_ids_against_all_pairs(spark):
    x = vectors_of(30, 16)
    rng = np.random.default_rng(2)
    x = np.vstack([x, x[:10] + 0.002 * rng.normal(size=(10, 16)), x[:5] * 3, x[20:25] + 0.05 * rng.normal(size=(5, 16))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i for i in range(len(u)) if any(u[i] @ u[j] > 0.999 for j in range(i))}
    got = {r["chunk_id"] for r in similar.redundant_ids(frame(spark, x)).collect()}
    assert got == want and want


def test_multi_query_and_merge(spark):
    x = vectors_of(20)
    subs = spark.createDataFrame([(0, s, [float(v) for v in x[s]]) for s in (3, 7)], "query_id int, subquery_id int, embedding array<double>")
    hits = {r["chunk_id"]: r["best_rank"] for r in retrieval.multi_query(frame(spark, x), subs, 4, None).collect()}
    assert hits[3] == 1 and hits[7] == 1
    a = spark.createDataFrame([(0, c, r) for r, c in enumerate([10, 11, 12], 1)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(0, c, r) for r, c in enumerate([12, 13], 1)], "query_id int, chunk_id int, rank int")
    cut = retrieval.sieve(retrieval.merge([a, b]), 3).orderBy("pos").collect()
    assert [r["chunk_id"] for r in cut] == [10, 12, 11]


def test_store(spark, tmp_path):
    one = frame(spark, vectors_of(5))
    folder = str(tmp_path / "s")
    store.save(store.build(one), folder)
    assert store.load(spark, folder).count() == 5
    with pytest.raises(ValueError):
        store.append(one, one)
    with pytest.raises(ValueError):
        store.build(one, "other")
    with pytest.raises(ValueError):
        store.check_binary_options(normalise=True)
    store.check_embeddings(one)
    with pytest.raises(ValueError):
        store.check_embeddings(frame(spark, np.zeros((3, 4))))
    with pytest.raises(ValueError):
        store.check_embeddings(frame(spark, np.ones((3, 4))))
    assert store.delete(one, one.filter("chunk_id < 2").select("chunk_id")).count() == 3


# containment, names, labels, trees

def test_containment(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "lorem ipsum dolor sit amet consectetur", "a fox", "quick brown", "", "xx fox xx"]
    blocks = ["quick brown fox jumps", "fox", "ipsum dolor sit amet", "nothing of this sort at all", "a fox", "fox"]
    blocks += ["the quick brown fox jumps over the lazy", "sit amet consectetur", "consectetur adipiscing elit"]
    b = spark.createDataFrame(list(enumerate(blocks)), "block_id int, text string")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = sorted((i, j) for i, j in itertools.product(range(len(blocks)), range(len(texts))) if blocks[i] in texts[j])

    assert sorted(tuple(r) for r in containment.contained_in(b, t, "block_id", "doc_id").collect()) == want
    twice = b.withColumn("block_id", F.lit(1)).unionByName(spark.createDataFrame([(1, None), (1, "")], "block_id int, text string"))
    assert sorted(tuple(r) for r in containment.contained_in(twice, t, "block_id", "doc_id").collect()) == sorted({(1, j) for _, j in want})


def test_names_block_by_block(spark, monkeypatch):
    known = spark.createDataFrame([(n,) for n in ("alpha", "alphabet", "beta", "gamma", "delta")], "name string")
    known = known.unionByName(spark.createDataFrame([(None,)], "name string"))
    wanted = spark.createDataFrame([(w,) for w in ("alpha", "bet", "gamna", "del", "zeta", None)], "wanted string")

    def run():
        return {r["wanted"]: r["name"] for r in names.closest_names(wanted, known).collect()}

    first = run()
    assert first["alpha"] == "alpha" and first["bet"] == "beta" and first["gamna"] == "gamma" and first["del"] == "delta" and first["zeta"] == "beta" and first[None] is None
    monkeypatch.setattr(names, "LEAST_SEGMENT", 1)
    assert run() == first


def test_shortest_suffixes(spark):
    df = spark.createDataFrame([("a/x/f.pdf",), ("b/x/f.pdf",), ("c/g.pdf",), ("cc/gg.pdf",)], "path string")
    got = {r["path"]: r["label"] for r in shortest_suffixes(df).collect()}
    assert got == {"a/x/f.pdf": "a/x/f.pdf", "b/x/f.pdf": "b/x/f.pdf", "c/g.pdf": "c/g.pdf", "cc/gg.pdf": "gg.pdf"}


def test_tree(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "key string, parent string")
    roots = spark.createDataFrame([("a",), ("b",)], "key string")
    got = sorted(tuple(r) for r in tree.descendants(edges, roots).collect())
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "b", 0), ("b", "c", 1)]
    chain = spark.createDataFrame([(str(i + 1), str(i)) for i in range(12)], "key string, parent string")
    assert tree.descendants(chain, spark.createDataFrame([("0",)], "key string")).count() == 13
    with pytest.raises(ValueError):
        tree.descendants(chain.unionByName(spark.createDataFrame([("0", "12")], chain.schema)),
                         spark.createDataFrame([("0",)], "key string"))
    cols = spark.createDataFrame([("1", "A", None), ("2", "B", "1")], "key string, name string, parent string")
    assert tree.resolve_path(cols, ["A", "B"]) == "2"
    with pytest.raises(ValueError):
        tree.resolve_path(cols, ["B"])


# copies, caches, accounts

def test_merge_copies(spark):
    df = spark.createDataFrame([(1, "h", "x", {"a": "1"}), (2, "h", "y", {"a": "2", "b": "3"}), (3, "h", "x", {}), (4, "g", "z", {"c": "4"})],
                               "id int, content_hash string, source_tag string, metadata map<string,string>")
    got = {r["content_hash"]: r for r in dedup.merge_copies(df, "id", metadata="metadata").collect()}
    assert got["h"]["source_tag"] == "x y" and got["h"]["n_copies"] == 3 and got["h"]["metadata"] == {"a": "1", "b": "3"} and got["h"]["id"] == 1
    assert got["g"]["source_tag"] == "z"


def test_cached_computes_each_missing_key_once(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", 0)], "key string, value int")
    calls = []

    def compute(missing):
        rows = [r["key"] for r in missing.collect()]
        calls.extend(rows)
        return missing.withColumn("value", F.lit(1))

    got = sorted((r["key"], r["value"]) for r in dedup.cached(wanted, cache, "key", compute).collect())
    assert got == [("a", 0), ("b", 1), ("b", 1), ("c", 1)] and sorted(calls) == ["b", "c"]


def test_votes_with_cache(spark):
    pairs = spark.createDataFrame([("k1", "blue sky", "the sky is blue"), ("k2", "blue sky", "red sea")], "key string, question string, text string")
    cache = spark.createDataFrame([("k2", [9, 9, 9])], "key string, votes array<int>")
    got = {r["key"]: r["votes"] for r in models.votes_with_cache(pairs, cache, models.overlap_votes).collect()}
    assert got == {"k1": [10, 10, 10], "k2": [9, 9, 9]}


def test_pick_best(spark):
    def best(*probs):
        parses = F.array(*[F.struct(F.lit(str(i)).alias("name"), F.lit("t").alias("content"), F.lit(p).alias("prob")) for i, p in enumerate(probs)])
        row = spark.range(1).select(accounting.pick_best(parses).alias("b")).first()["b"]
        return row and row["name"]

    assert best(0.6, 0.96, 0.99) == "1" and best(0.6, 0.7, 0.8, 0.94) == "2" and best(0.1, 0.2) is None and best(0.7, 0.7) == "0"


def test_spend_guard():
    accounting.check_spend(1, 5)
    accounting.check_spend(9, 5, own_endpoint=True)
    with pytest.raises(ValueError):
        accounting.check_spend(9, 5)


# batches

def test_ward_heights_are_centroid_distances():
    x = vectors_of(12, 5)
    members = {i: [i] for i in range(12)}
    for step, (a, b, height) in enumerate(batching.ward(batching.distances(x))):
        na, nb = len(members[a]), len(members[b])
        gap = np.linalg.norm(x[members[a]].mean(0) - x[members[b]].mean(0))
        assert height == pytest.approx(np.sqrt(2 * na * nb / (na + nb)) * gap, rel=1e-6)
        members[12 + step] = members[a] + members[b]


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 8), st.integers(0, 1000))
def test_leaf_order_is_optimal(n, seed):
    dist = batching.distances(vectors_of(n, 4, seed))
    merges = batching.ward(dist)
    children = {n + i: (a, b) for i, (a, b, _) in enumerate(merges)}

    def orders(node):
        if node < n:
            return [[node]]
        left, right = (orders(c) for c in children[node])
        return [x + y for a, b in itertools.product(left, right) for x, y in ((a, b), (b, a))]

    def cost(order):
        return sum(dist[i, j] for i, j in itertools.pairwise(order))

    got = batching.leaf_order(merges, dist)
    assert sorted(got) == list(range(n))
    assert cost(got) == pytest.approx(min(cost(o) for o in orders(n + len(merges) - 1)))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10_000), st.integers(50, 3000))
def test_batches_lose_nothing(n, seed, cap):
    sizes = np.random.default_rng(seed).integers(1, 1500, size=n)
    found = batching.batches(vectors_of(n, 12, seed), sizes, cap)
    assert sorted(i for b in found for i in b) == list(range(n))
    assert n < 2 or all(len(b) >= 2 for b in found)
    assert n > 3 or len(found) == 1


def test_batches_group_by_topic(spark):
    x = np.array([[1, 0.1, 0, 0], [0, 0, 1, 0.1], [1, 0, 0.1, 0], [0, 0.1, 1, 0]], dtype=float)
    found = batching.batches(x, np.array([600, 600, 600, 600]), 2000)
    assert sorted(map(sorted, found)) == [[0, 2], [1, 3]]
    df = spark.createDataFrame([(0, i, 600, row.tolist()) for i, row in enumerate(x)], "query_id int, id int, tokens int, embedding array<double>")
    rows = batching.semantic_batches(df, ["query_id"], "id").collect()
    assert len(rows) == 4 and len({r["batch"] for r in rows}) == 2


# models

def test_hash_embedding(spark):
    df = spark.createDataFrame([("a cat and a dog",), ("A CAT, and a dog!",), ("other words",)], "t string")
    a, b, c = (r["e"] for r in df.select(models.hash_embedding(F.col("t")).alias("e")).collect())
    assert a == b != c and np.linalg.norm(a) == pytest.approx(1)
    with pytest.raises(Exception, match="empty text"):
        spark.createDataFrame([("  ",)], "t string").select(models.hash_embedding(F.col("t"))).collect()


def test_python_model(spark):
    shout = models.python_model(lambda texts: [t.upper() for t in texts], "string")
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r[0] for r in df.select(shout(F.col("t"))).collect()] == ["A", "B"]


def test_tags_in(one):
    assert one(models.tags_in(F.lit("x <tags>\nlong tag\n\nab\n</tags>"))) == ["ab", "long tag"]


def test_compressed_store_keeps_the_vectors(spark, tmp_path):
    x = vectors_of(20) * 3
    store.save(store.build(frame(spark, x), "compressed"), f"{tmp_path}/s", backend="compressed")
    got = {r["chunk_id"]: r["embedding"] for r in store.load(spark, f"{tmp_path}/s").collect()}
    flat = {r["chunk_id"]: r["embedding"] for r in store.build(frame(spark, x)).collect()}
    assert got == flat


def test_kept_hashes_leave_a_worker_in_bounded_batches(spark, monkeypatch):
    """Whatever a batch of texts gives, no list of all its hashes is made."""
    import pyarrow as pa

    text = "".join(chr(c) for c in np.random.default_rng(0).integers(97, 123, 3000))
    batch = pa.record_batch({"id": pa.array(range(40)), "text": pa.array([text[i:] for i in range(40)])})
    made = {}
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: made.setdefault("run", run))
    monkeypatch.setattr(containment, "OUT_ROWS", 1_000)
    out = list(made["run"](iter([batch]))) if containment._kept(rows, "id", "text") else []
    longest = len(containment._kept_hashes(text))
    assert len(out) > 5 and max(b.num_rows for b in out) <= 1_000 + longest
    assert sum(b.num_rows for b in out) == sum(len(containment._kept_hashes(text[i:])) for i in range(40))


def test_merge_copies_moves_only_columns_asked_for(spark):
    docs = spark.createDataFrame([("h", "b", "t1", "text", None), ("h", "a", "t2", "text", 5), ("g", "c", "t1", "more", None)],
                                 "content_hash string, path string, source_tag string, page_content string, n int")
    merged = dedup.merge_copies(docs, "path")
    assert sorted(tuple(r) for r in merged.select("path", "n_copies", "source_tag", "page_content", "n").collect()) == [
        ("a", 2, "t2 t1", "text", 5), ("c", 1, "t1", "more", None)]
    plan = merged.select("path", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "page_content" not in plan.split("LogicalRDD")[0]


def test_border_copies_of_vectors_are_not_stored(spark, monkeypatch):
    x = vectors_of(200)
    stored = []

    def counted(df):
        out = plain(df)
        if {"_v", "_w"} & set(out.columns):
            stored.append(out.count())
        return out

    plain = similar.checkpointed
    monkeypatch.setattr(similar, "checkpointed", counted)
    monkeypatch.setattr(similar, "CELL_ROWS", 8)
    got = {r["chunk_id"] for r in similar.redundant_ids(frame(spark, x), 0.9).collect()}
    assert got == {i for i in range(200) if (x[i] @ x[:i].T > 0.9).any()} and got
    assert stored and max(stored) <= 200


def test_vectors_without_partner_are_not_stored(spark, monkeypatch):
    stored = []

    def counted(df):
        out = plain(df)
        stored.append(out.count() if any(kind.startswith("array") for _, kind in out.dtypes) else 0)
        return out

    plain = similar.checkpointed
    monkeypatch.setattr(similar, "checkpointed", counted)
    x = np.vstack([vectors_of(200, 32), 2 * vectors_of(50, 32)])
    assert {r["chunk_id"] for r in similar.redundant_ids(frame(spark, x)).collect()} == set(range(200, 250))
    assert stored and max(stored) == 0


def test_redundant_ids_of_crowded_cells_against_all_pairs(spark, monkeypatch):
    for name, most in (("CUT_ROWS", 6), ("CELL_ROWS", 4), ("SKETCH_ROWS", 8), ("ALIKE_ROWS", 3), ("PIVOTS", 2),
                       ("SHIPPED_CELLS", 1), ("SHIPPED_PIVOTS", 1), ("SHIPPED_ROWS", 1)):
        monkeypatch.setattr(similar, name, most)
    rng = np.random.default_rng(5)
    x = vectors_of(60, 24, seed=5)
    # a crowd about one vector, pairs about the threshold, and three copies of some
    x = np.vstack([x, x[3] + 0.012 * rng.normal(size=(60, 24)), x[:20] + 0.009 * rng.normal(size=(20, 24)), x[10:15], 4 * x[10:15]])
    rows = [(int(i), [float(v) for v in row], None if i % 5 == 0 else f"k{i % 2}") for i, row in zip(rng.permutation(len(x)), x, strict=True)]
    rows += [(1000, None, "k0"), (None, rows[0][1], "k1"), (1001, [0.0] * 24, "k0"), (1002, [1.0, None], "k1"), (1003, [None, 1.0], "k1"),
             (1004, [1.0, None], "k1"), (1005, [-0.0] * 24, "k0"), rows[7], (rows[9][0], rows[11][1], rows[9][2])]

    def near(a, b):
        if any(v is None for v in a + b) or len(a) != len(b):
            return a == b
        a, b = np.array(a), np.array(b)
        return (a == b).all() or a @ b > 0.999 * np.linalg.norm(a) * np.linalg.norm(b)

    want = {(i, k) for i, v, k in rows for j, w, m in rows
            if None not in (i, v, j, w) and j < i and k == m and near(v, w)}
    frame_ = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, kind string")
    got = [tuple(r) for r in similar.redundant_ids(frame_, keys=("kind",)).select("chunk_id", "kind").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {1004, 1005} <= {i for i, _ in got}
