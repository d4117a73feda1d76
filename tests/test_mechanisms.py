"""Greedy cuts, staged ways, the cache table and the frontier, against plain versions."""

import random

import pytest
from corpusmill.operators.cache_table import CacheTable, through
from corpusmill.operators.frontier import judge_frontier
from corpusmill.operators.greedy import greedy_batches
from corpusmill.operators.staged import fall_through
from pyspark.sql import functions as F


def plain_batches(sizes, limit, most):
    out, batch, held, count = [], 0, 0, 0
    for size in sizes:
        if count and (held + size > limit or count >= most):
            batch, held, count = batch + 1, 0, 0
        held, count = held + size, count + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("n,limit,most,rows,spread", [
    (1, 10, 3, None, 1), (500, 50, 4, 4, 3), (1000, 30, 7, 9, 1), (1000, 10**9, 5, 20, 4097), (300, 1, 50, 50, 2),
    (777, 100, 100, 100, 1)])
def test_greedy_batches(spark, n, limit, most, rows, spread):
    rng = random.Random(n + most)
    ids = sorted(rng.sample(range(-n * spread, n * spread), n))
    sizes = [rng.choice([0, 1, 5, 9, 40, 200]) for _ in ids]
    df = spark.createDataFrame(list(zip(ids, sizes, strict=True)), "doc_id bigint, tkn int").repartition(5)
    got = greedy_batches(df, "doc_id", F.col("tkn"), limit, most, block_rows=rows).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == ids
    assert [r["batch"] for r in got] == plain_batches(sizes, limit, most)


def test_greedy_batches_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 5), (1, None), (2, 3)], "doc_id int, tkn int")
    got = greedy_batches(df, "doc_id", F.col("tkn"), 3, 9)
    assert dict(got.dtypes)["doc_id"] == "int" and sorted(map(tuple, got.collect())) == [(1, 0), (2, 0)]
    assert greedy_batches(df.limit(0), "doc_id", F.col("tkn"), 3, 9).count() == 0
    with pytest.raises(ValueError):
        greedy_batches(df, "doc_id", F.col("tkn"), 0, 9)


def test_no_task_holds_more_than_a_block(spark):
    """10,000 rows of batches of 10: groups of 170 rows at most."""
    df = spark.range(10_000).withColumnRenamed("id", "doc_id")
    got = greedy_batches(df, "doc_id", F.lit(1), 10**9, 10)
    assert got.groupBy("batch").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (10, 10, 1000)


def test_fall_through(spark):
    """Ratings are written into the contents: x0.97 settles, three of 0.5 and more settle, failures go on."""
    given = [(1, "x0.97", "x0.99", "x1.0", "x1.0"), (2, "x0.6", "x0.7", "x0.7", "x1.0"), (3, "x0.6", None, "x0.96", "x1.0"),
             (4, None, "x0.1", "x0.2", "x0.95"), (5, None, None, None, None), (6, "x0.4", "x0.49", None, "x0.2"),
             (7, "x0.6", "x0.6", None, "x0.6")]
    df = spark.createDataFrame(given, "k int, a string, b string, c string, d string")
    seen = spark.sparkContext.accumulator(0)

    def stage(name):
        return name, lambda rows: F.col(name)

    found = fall_through(df, "k", [stage(n) for n in "abcd"], lambda c: F.substr(c, F.lit(2)).cast("double"))
    got = {r["k"]: (r["content"], r["stage"], r["calls"]) for r in found.collect()}
    assert seen.value == 0 and got == {
        1: ("x0.97", "a", 1), 2: ("x0.7", "b", 3), 3: ("x0.96", "c", 3), 4: ("x0.95", "d", 4), 5: (None, None, 4),
        6: (None, None, 4), 7: ("x0.6", "a", 4)}


def test_later_stages_see_open_rows_only(spark):
    from pyspark.sql.functions import udf

    calls = spark.sparkContext.accumulator(0)

    def count(value):
        calls.add(1)
        return value

    counted = udf(count, "string").asNondeterministic()
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") < 90, "1.0").otherwise("0.1").alias("v"))
    found = fall_through(df, "k", [("first", lambda _: F.col("v")), ("second", lambda _: counted("v"))], lambda c: c.cast("double"))
    found.collect()
    found.collect()
    assert calls.value == 10  # the results are stored: no call is repeated


@pytest.fixture
def cache(spark, tmp_path):
    return CacheTable(spark, str(tmp_path / "cache"), "int", days=10)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value int")


def day(n):
    return F.lit(f"2024-01-{n:02d}").cast("timestamp")


def held(cache, n):
    return {r["key"]: r["value"] for r in cache.items(now=day(n)).collect()}


def test_cache_table(spark, cache):
    assert held(cache, 1) == {} and cache.keys().count() == 0
    cache.compact(now=day(1))
    cache.mset(rows(spark, ("a", 1), ("b", 2), ("b", 3), (None, 4), ("c", None)), now=day(1))
    assert held(cache, 2) == {"a": 1, "b": 3, "c": None}
    cache.mset(rows(spark, ("a", 7)), now=day(3))
    cache.mdelete(rows(spark, ("b", 0), ("nobody", 0)), now=day(3))
    assert held(cache, 4) == {"a": 7, "c": None}
    wanted = rows(spark, ("a", 0), ("a", 0), ("b", 0), (None, 0)).drop("value").withColumn("extra", F.lit("x"))
    assert [tuple(r) for r in cache.mget(wanted, now=day(4)).collect()] == [("a", "x", 7)] * 2
    assert sorted(str(r["key"]) for r in cache.missing(wanted, now=day(4)).collect()) == ["None", "b"]
    assert [r["key"] for r in cache.keys("c", now=day(4)).collect()] == ["c"]
    assert held(cache, 12) == {"a": 7}                      # ten days after the first of January
    for n in (4, 4):
        cache.compact(now=day(n))
        assert held(cache, 5) == {"a": 7, "c": None}
    cache.mset(rows(spark, ("b", 9)), now=day(5))
    cache.mdelete(rows(spark, ("a", 0)), now=day(5))
    assert held(cache, 6) == {"b": 9, "c": None}
    cache.compact(now=day(6))
    assert held(cache, 6) == {"b": 9, "c": None}
    assert held(CacheTable(spark, cache.folder, "int", days=10), 6) == {"b": 9, "c": None}


def test_a_run_written_during_compaction_is_kept(spark, cache, monkeypatch):
    cache.mset(rows(spark, ("a", 1)), now=day(1))
    state = cache._state()
    cache.mset(rows(spark, ("a", 2), ("z", 5)), now=day(1))  # after compaction looked
    monkeypatch.setattr(cache, "_state", lambda: state)
    cache.compact(now=day(1))
    monkeypatch.undo()
    assert held(cache, 2) == {"a": 2, "z": 5}


def test_random_histories(spark, tmp_path):
    rng = random.Random(4)
    cache, model = CacheTable(spark, str(tmp_path / "h"), "int"), {}
    for step in range(8):
        some = rng.sample("abcdefgh", 4)
        if rng.random() < 0.35:
            cache.mdelete(rows(spark, *((k, 0) for k in some)))
            for k in some:
                model.pop(k, None)
        else:
            cache.mset(rows(spark, *((k, step) for k in some)))
            model.update(dict.fromkeys(some, step))
        if step % 3 == 2:
            cache.compact()
    assert {r["key"]: r["value"] for r in cache.items().collect()} == model


def test_through_asks_once(spark, cache):
    asked = []

    def compute(lacking):
        asked.append(lacking.count())
        return lacking.withColumn("value", F.length("key"))

    wanted = rows(spark, ("aa", 0), ("bbb", 0), ("aa", 0)).drop("value")
    found, calls = through(cache, wanted, "key", compute)
    assert sorted(map(tuple, found.collect())) == [("aa", 2), ("aa", 2), ("bbb", 3)] and calls == 2
    again, calls = through(cache, wanted, "key", compute)
    assert again.count() == 3 and calls == 0 and asked == [2]


def test_frontier(spark, tmp_path):
    """Question 1 keeps everything, 2 nothing, 3 has few hits; only what is asked for is judged."""
    hits = spark.createDataFrame([(q, r, f"{q}-{r}") for q, n in ((1, 40), (2, 40), (3, 3)) for r in range(1, n + 1)],
                                 "query_id int, rank int, text string")
    votes = CacheTable(spark, str(tmp_path / "v"), "int")

    def judge(pairs):
        return pairs.withColumn("value", F.when(F.col("query_id") == 2, 0).otherwise(9))

    for expected in ([13, 5, 15], [0, 0, 0]):
        judged, sizes, calls = judge_frontier(hits, F.col("text"), judge, lambda v: v > 5, [5, 10, 25], 0.9, votes)
        assert {tuple(r) for r in sizes.collect()} == {(1, 25, 25), (2, 5, 0), (3, 5, 3)}
        assert calls == expected
        assert judged.count() == 25 + 5 + 3 and judged.filter("keep").count() == 28


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def meant(wanted, names):
    if wanted is None or not names:
        return None
    if wanted in names:
        return wanted
    starts = [n for n in names if n.startswith(wanted)]
    return starts[0] if len(starts) == 1 else min(names, key=lambda n: (levenshtein(wanted, n), n))


@pytest.mark.parametrize("seed,letters,longest", [(1, "ab", 8), (2, "abcdefg", 14), (3, "abc ", 30)])
def test_closest_names(spark, seed, letters, longest):
    from corpusmill.operators.names import closest_names

    rng = random.Random(seed)
    names = {"".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(60)}
    asked = ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(30)]
    for name in rng.sample(sorted(names), 20):
        at = rng.randrange(len(name))
        asked += [name, name[:-1], name[:at] + "z" + name[at + 1:], name[:at] + name[at + 1:] + "z"]
    asked += [None, "", "q" * 40, "日本"]
    wanted = spark.createDataFrame([(i, w) for i, w in enumerate(asked)], "i int, wanted string")
    known = spark.createDataFrame([(n,) for n in [*names, *names, None]], "name string")
    got = {r["i"]: r["name"] for r in closest_names(wanted, known).collect()}
    assert got == {i: meant(w, names) for i, w in enumerate(asked)}
    assert {r["name"] for r in closest_names(wanted, known.limit(0)).collect()} == {None}


def test_staged_parse_rounds_and_falls_back_as_in_sql(spark, tmp_path):
    """999 letters of 1,920 characters are 0.5203125, which doubles scale to just below the half; debris keeps its title."""
    import duckdb
    from compare import rows_of
    from corpusmill.plans.catalog import load

    pages = [(i, f"<h1>{'a' * k + '1' * (n - k)}</h1>") for i, (k, n) in enumerate([(999, 1920), (333, 640), (646, 1280), (1, 64), (2, 3)])]
    pages += [(8, "<title>12345</title>"), (9, "123"), (10, "")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    queries, oracles = load()
    got, want = queries["staged_parse"](spark, str(tmp_path)), con.sql(oracles["staged_parse"])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
