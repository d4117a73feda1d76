"""Toxicity and language: held-out figures, odd inputs, repeatability."""

import random
import zlib

import pytest
from corpusmill.llm import language, mixing, toxicity
from corpusmill.llm.catalog import QUERIES
from helpers import documents
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 34 !!"), (4, "x" * 100_000), (4, "x" * 100_000), (None, "you are an idiot"),
       (6, "idiot " * 30_000), (7, "ｏｋ ºª ٣"), (8, ". . ; \n\n")]


def test_op10(spark):
    rows = QUERIES["op10_toxicity"](spark, SF).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 == len({r["doc_id"] for r in rows})
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    clean = [p for t, p in held if t == 0]
    assert sum(clean) <= 0.03 * len(clean)
    assert sum(t == p for t, p in held) >= 0.95 * len(held)


def test_op8(spark):
    rows = QUERIES["op8_language"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(truth) and len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_clauses_not_words():
    g = toxicity.Grammar()
    plain, aimed = g.judge("what an idiot sits there")[0], g.judge("you are an idiot")[0]
    negated, reported = g.judge("this is not an idiot here")[0], g.judge("they said idiot")[0]
    assert negated < plain and reported < plain < aimed
    assert g.judge("all well. you idiot! fine")[1] == [1]
    assert g.judge("we will kill you")[0] > g.judge("we will kill time")[0]
    assert g.judge("a table")[0] < 0.5


def test_composed_automaton_equals_its_parts():
    after, events = toxicity.compose(near=4)
    rng = random.Random(4)
    for _ in range(200):
        word = [rng.randrange(6) for _ in range(12)]
        state = 0
        for i, symbol in enumerate(word):
            past = word[:i]
            flags = ((toxicity.TARGET in past[-4:]) | (toxicity.NEGATION in past[-3:]) << 1
                     | (toxicity.REPORT in past) << 2)
            want = {toxicity.INSULT: flags, toxicity.THREAT: 8 + flags}.get(symbol, -1)
            assert events[state][symbol] == want
            state = after[state][symbol]


def test_toxicity_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("toxicity", F.lit("clash")).withColumn("score", F.lit(1))
    rows = toxicity.score(docs, toxicity.Grammar()).collect()
    assert len(rows) == len(ODD) and all(0 <= r["toxicity"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(r["toxicity"])
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[None] == by_text[""]
    assert max(by_text["idiot " * 30_000]) > 0.5


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 1), (6, 0)]])
def test_toxicity_without_labels(spark, labels):
    docs = documents(spark, ODD)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    grammar = toxicity.train(toxicity.training_rows(docs, known))
    assert grammar.weights == toxicity.Grammar().weights
    assert toxicity.score(documents(spark, []), grammar).count() == 0


def test_learned_stems(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "ve", "so", "pi")]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(40)]
        if i % 8 == 0:
            for _ in range(4):
                text[rng.randrange(40)] = "zorg" + rng.choice(words)
        rows.append((i, " ".join(text)))
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    grammar = toxicity.train(toxicity.training_rows(docs, labels))
    got = {r["doc_id"]: r["toxicity"] >= 0.5 for r in toxicity.score(docs, grammar).collect()}
    assert got == {i: i % 8 == 0 for i in range(400)}


def test_language_odd_rows(spark):
    texts = {"xx": "abra cadabra bra", "yy": "hum hom hem hurum"}
    rows = [(i, f"{texts[la]} {i}", la, None) for i in range(60) for la in texts] + [(1, None, "xx", None), (2, "a", None, None)]
    model = language.train(documents(spark, rows))
    assert model.languages == ["xx", "yy"]
    docs = documents(spark, ODD + [(9, "bra abra"), (10, "hurum")]).withColumn("lang_pred", F.lit("clash"))
    got = {r["text"]: r for r in language.predict(docs, model).collect()}
    for und in (None, "", "12 34 !!", ". . ; \n\n"):
        assert (got[und]["lang_pred"], got[und]["lang_score"]) == ("und", 0.0)
    assert got["bra abra"]["lang_pred"] == "xx" and got["hurum"]["lang_pred"] == "yy"
    assert got["ｏｋ ºª ٣"]["lang_pred"] in ("xx", "yy")
    assert language.predict(documents(spark, []), model).count() == 0


def test_language_learns_nothing_from_nothing(spark):
    model = language.train(documents(spark, []))
    assert language.predict(documents(spark, [(1, "abc")]), model).first()["lang_pred"] == "und"


def test_weights_are_sparse(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert (language.train(docs).weights != 0).mean() < 0.1


CLASHING = ["_rest", "_left", "_s", "_l", "_pattern", "found", "pattern", "rank", "bucket", "base", "inside", "whole",
            "rest", "buckets", "left", "words", "rows", "sent", "at", "part", "weight", "slot"]


def test_clashing_names(spark):
    """Columns named like inner ones come out as they went in."""
    docs = documents(spark, [(i, f"you are an idiot number {i}", "en", "abc"[i % 3]) for i in range(9)])
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING})
    scored = toxicity.score(docs, toxicity.Grammar())
    named = language.predict(docs, language.train(docs))
    mixed = mixing.mix(docs)
    for out in (scored, named, mixed):
        rows = out.collect()
        assert len(rows) == 9 and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING)


def test_training_on_one_hot_id(spark):
    """60,000 rows of one id (or none): the samples keep their bound, and something is learned."""
    hot = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 7).cast("bigint").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, "das ist ein haus und der hund").otherwise("this is the house and a dog").alias("text"), F.when(
        F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"))
    model = language.train(hot, most_rows=500)
    assert model.languages == ["de", "en"] and model.predict("the dog")[0] == "en"
    labels = spark.createDataFrame([(7, 1), (7, 0), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.training_rows(hot, labels, most_rows=300).count() == 300
