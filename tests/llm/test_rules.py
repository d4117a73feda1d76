"""The rule ensemble: its parts against plain versions, and held-out rows."""

import zlib

import numpy as np
import pytest
from corpusmill.llm import rules, sampling
from corpusmill.llm.catalog import QUERIES
from helpers import ODD_ROWS, documents
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"
LABELS = "doc_id bigint, quality int, toxic int"


def test_expression_is_the_ensemble(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join("ab$%."[int(j)] * int(rng.integers(1, 9)) for j in rng.integers(0, 5, rng.integers(0, 40))))
            for i in range(300)]
    x = np.array([rules.statistics_of(t) for _, t in docs])
    y = (x[:, rules.STATISTICS.index("symbol_share")] > 0.4).astype(float)
    model = rules.fit(x, y)
    assert model.rules and ((model.predict(x) > 0.5) == y).mean() > 0.97
    assert len(model.text()) == len(model.rules)
    got = {r["doc_id"]: r["quality_score"] for r in rules.score(documents(spark, docs), model).collect()}
    assert np.allclose([got[i] for i in range(300)], model.predict(x), atol=1e-12)


def test_rules_are_paths():
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    grown = rules.grow_rules(x, y, trees=3)
    assert len(grown) == len(set(grown))
    best = max(grown, key=lambda r: abs(np.corrcoef(rules.covers(r, x), y)[0, 1]))
    assert {s for s, _, _ in best} == {0, 1} and np.corrcoef(rules.covers(best, x), y)[0, 1] > 0.95


def test_lasso_meets_its_conditions():
    """At the minimum the gradient of each weight is the penalty, or below it where the weight is 0."""
    rng = np.random.default_rng(4)
    x = rng.random((300, 6)).round()
    y = (rng.random(300) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    w = rules.lasso(x, y, 0.02)
    g = np.hstack([np.ones((300, 1)), x]).T @ (y - 1 / (1 + np.exp(-(w[0] + x @ w[1:])))) / 300
    assert abs(g[0]) < 1e-4
    for weight, slope in zip(w[1:], g[1:], strict=True):
        assert abs(slope - 0.02 * np.sign(weight)) < 1e-3 if weight else abs(slope) <= 0.02 + 1e-6
    assert (w[1:] == 0).any() and w[1] > 0 > w[2]


def test_statistics():
    got = dict(zip(rules.STATISTICS, rules.statistics_of("AB cd$ cd$\nEnd. 12\nEnd. 12"), strict=True))
    assert got["words"] == 7 and got["lines"] == 3 and got["upper_words"] == pytest.approx(1 / 7)
    assert got["symbol_words"] == pytest.approx(2 / 7) and got["repeated_lines"] == pytest.approx(1 / 3)
    assert rules.statistics_of("") == (0.0,) * 18


def test_odd_rows_and_names(spark):
    model = rules.Ensemble(0.5, [(((0, 3.0, 10.0),), 1.5)])
    docs = documents(spark, ODD_ROWS).withColumn("statistics", F.lit("s")).withColumn("Quality_Score", F.lit(1))
    rows = rules.score(docs, model).collect()
    assert len(rows) == len(ODD_ROWS) and {r["statistics"] for r in rows} == {"s"}
    for r in rows:
        want = 1 / (1 + np.exp(-(0.5 + 1.5 * (3 < len(r["text"] or "") <= 10))))
        assert r["quality_score"] == pytest.approx(want)
    assert rules.score(documents(spark, []), model).count() == 0


def test_training_without_labels(spark):
    empty = rules.train(documents(spark, ODD_ROWS), spark.createDataFrame([], LABELS))
    assert empty == rules.Ensemble()
    one_sided = spark.createDataFrame([(1, 1, 0), (6, 1, None), (None, 0, 0), (9, None, 1)], LABELS)
    assert rules.train(documents(spark, ODD_ROWS), one_sided) == rules.Ensemble()


@pytest.mark.parametrize("rows", [0, 1, 500, 60_000, 70_000])
def test_bounded_sample_of_repeated_rows(spark, rows):
    df = spark.range(60_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("x").alias("text")).union(
        spark.range(100).select(F.lit(None).cast("bigint"), F.lit(None).cast("string")))
    assert sampling.bounded_sample(df, ["doc_id", "text"], rows, 3).count() == min(rows, 60_100)


def test_labelled_rows_are_bounded(spark):
    docs = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], LABELS)
    found = sampling.labelled_rows(docs, labels, "quality", most_rows=300)
    assert found.count() == 300 and {r["quality"] for r in found.collect()} == {1}


def test_op13(spark):
    rows = QUERIES["op13_quality"](spark, SF).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    good, bad = ([r["score"] for r in held if truth[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.97
