"""License scans against full alignment, and the pipeline stage by stage."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from corpusmill.llm import licenses
from corpusmill.llm.catalog import QUERIES
from helpers import ODD_ROWS, documents
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
BY_NAME = dict(licenses.TEMPLATES)


def words(text):
    return licenses.WORD.findall(text.lower())


def common(a, b):
    """Length of the longest common subsequence, by the full table."""
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, best[j] = best[j], before + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def test_op2_finds_every_notice(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["op2_licenses"](spark, SF).collect():
        got.setdefault((r["doc_id"], r["license"]), []).append(docs[r["doc_id"]][r["start"]:r["end"]])
        part = docs[r["doc_id"]][r["start"]:r["end"]]
        assert common(words(BY_NAME[r["license"]]), words(part)) >= r["matched_words"] >= 0.75 * r["template_words"]
    for name in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", "all-rights-reserved"):
        notice = BY_NAME[name]
        want = {d: len(re.findall(re.escape(notice), t)) for d, t in docs.items() if notice in t}
        assert {d: len(v) for (d, n), v in got.items() if n == name} == want
    assert got


def test_changed_notices():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.75, 8)
    mit = BY_NAME["MIT-text"]
    rng = random.Random(3)
    for _ in range(30):
        w = mit.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = rng.choice(["foo", "bar", ""])
        text = "some words before. " + " ".join(w) + " and after it"
        found = [f for f in scanner.scan(text) if f[0] == "MIT-text"]
        if common(words(mit), words(" ".join(w))) >= 0.75 * len(words(mit)):
            assert len(found) == 1
            _, start, end, coverage, matched, size = found[0]
            assert matched == round(coverage * size) == common(words(mit), words(text[start:end]))
    assert not [f for f in scanner.scan("the software and the use of it, in source and in binary") if f[0] == "MIT-text"]


def test_alignment_is_longest_in_its_band():
    rng = random.Random(1)
    for _ in range(100):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))]
        b = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))]
        match = licenses.align(a, np.array(b), 0, 9)
        assert len(match) == common(a, b)
        assert all(a[i] == b[j] for i, j in match) and match == sorted(match)
        assert len({i for i, _ in match}) == len({j for _, j in match}) == len(match)


def test_winnowing_keeps_one_in_each_window():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 300).astype("u8")
    for w in (2, 5):
        kept = licenses.winnow(h, w)
        assert all(((kept >= i) & (kept < i + w)).any() for i in range(len(h) - w + 1)) and len(kept) < len(h)


def test_odd_license_rows(spark):
    notice = BY_NAME["Apache-2.0"]
    rows = [*ODD_ROWS, (20, notice), (20, notice), (None, f"İİİ {notice.upper()} İ"), (21, "zip " * 40_000 + notice), (22, f"{notice} {notice}")]
    docs = documents(spark, rows).withColumn("license", F.lit("x")).withColumn("start", F.lit(1))
    got = [(r["doc_id"], r["start"], r["end"]) for r in licenses.scan_licenses(docs).collect() if r["license"] == "Apache-2.0"]
    size = len(notice.rstrip("."))
    want = [(20, 0, size), (20, 0, size), (None, 4, 4 + size), (21, 160_000, 160_000 + size), (22, 0, size),
            (22, len(notice) + 1, len(notice) + 1 + size)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


EN, DE = "the and of that with from have this was not", "der und die nicht mit auf ein sich das von"


def pipeline_rows():
    rng, rows = random.Random(8), []
    for i in range(120):
        base = (EN if i % 2 else DE).split()
        rows.append((i, " ".join(rng.choice(base) + rng.choice(["ab", "cd", "ef", "gh", ""]) for _ in range(60)),
                     "en" if i % 2 else "de", f"s{i % 3}"))
    rows += [(200, rows[1][1], "en", "s0"), (201, rows[1][1] + " more", "en", "s1"), (1, rows[1][1], "en", "s1"),
             (202, "you are an idiot and a moron. you scum", "en", "s0"), (203, None, None, None), (204, "", "en", "s0"),
             (205, "12 34", "en", None), (None, rows[2][1] + " x", "de", "s1")]
    return rows


def test_stages(spark, tmp_path):
    spark.createDataFrame([(202, 1), (1, 0)], "doc_id bigint, quality int").withColumnRenamed("quality", "toxic").write.parquet(
        f"{tmp_path}/labels.parquet")
    rows = pipeline_rows()
    docs = documents(spark, rows).coalesce(1).withColumn("toxicity", F.lit("clash")).withColumn("mix_size", F.lit(7))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: [r["doc_id"] for r in d.collect()] for n, d in kept.items()}
    assert len(ids["toxicity"]) == len(rows) - 1 and 202 not in ids["toxicity"]
    assert set(ids["toxicity"]) - set(ids["language"]) == {203, 204, 205}
    assert set(ids["language"]) - set(ids["near_copies"]) == {200, 201, None} and len(ids["near_copies"]) == 120
    mixed = kept["mixing"].collect()
    size = {r["source"]: 0 for r in mixed}
    for r in kept["near_copies"].collect():
        size[r["source"]] += len(r["text"].split())
    total = sum(size.values())
    for source, weight in zip(sorted(size), (5, 2, 1), strict=True):
        got = sum(len(r["text"].split()) for r in mixed if r["source"] == source)
        assert abs(got - weight / 8 * total) <= 1 and got <= 3 * size[source]
    assert sum(r["length"] for r in kept["packing"].collect()) == sum(
        len(x) for x in kept["packing"].select(F.col("ids")).toPandas()["ids"]) // 4
    assert {r["doc_id"] for r in kept["packing"].collect()} == set(ids["mixing"])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (None, "", "en", "s")]])
def test_stages_of_little(spark, tmp_path, rows):
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_keep_their_numbers(spark, tmp_path, monkeypatch):
    """Files that are read in other splits after the components are known change nothing."""
    texts = [" ".join(f"t{i}w{k}" for k in range(20)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:10])]
    documents(spark, rows).repartition(8).write.parquet(f"{tmp_path}/docs")
    original, conf = corpus_pipeline.jaccard.jaccard_components, spark.conf

    def components(docs):
        found = corpus_pipeline.stored(original(docs), "found")
        conf.set("spark.sql.files.minPartitionNum", "1")
        return found

    conf.set("spark.sql.files.minPartitionNum", "8")
    monkeypatch.setattr(corpus_pipeline.jaccard, "jaccard_components", components)
    try:
        kept = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path)).collect()
    finally:
        conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r["text"] for r in kept) == sorted(texts)


@pytest.mark.parametrize("text, names", [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0-short"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0-short"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-NC 2.5.", []),
    ("Released under the BSD License.", []), ("Licensed under the Apache License, Version 1.1.", []),
    (f"x {BY_NAME['MIT']} {BY_NAME['GPL-3.0']}", ["MIT", "GPL-3.0"])])
def test_versions_and_variants(text, names):
    found = licenses.Scanner(licenses.TEMPLATES, 0.75, 8).scan(text)
    assert [f[0] for f in sorted(found, key=lambda f: f[1])] == names


def test_every_template_is_itself():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.75, 8)
    assert len(BY_NAME) == len(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        assert [(f[0], f[3]) for f in scanner.scan(f"before it {text} after it")] == [(name, 1.0)]
