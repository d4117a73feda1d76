"""Packing and token files against the plain tokenizer."""

import numpy as np
import pytest
from corpusmill.llm import packing, token_files
from corpusmill.llm.bpe import default_vocabulary, encoder
from corpusmill.llm.catalog import QUERIES
from helpers import ODD_ROWS, crc, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def plain():
    return lambda text: TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\xa0ab,.1é漢'<|>", max_size=40))
def test_words_encode_like_texts(text):
    got = np.frombuffer(encoder(default_vocabulary()).encode([text])[0], "<u2").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def check_pieces(rows, docs, plain, window):
    """Each id of each document in exactly one piece; sequences gapless and full."""
    want = sorted([(-1 if d is None else d, plain(t) + [1]) for d, t in docs])
    sequences, built = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0 and r["offset"] + r["length"] <= window
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"]))
        key = (-1 if r["doc_id"] is None else r["doc_id"], r["sequence_id"] * window + r["offset"] - r["start"])
        built.setdefault(key, []).append((r["start"], ids, r["doc_tokens"]))
    got = []
    for (doc, _), pieces in built.items():
        pieces.sort()
        ids = [i for _, part, _ in pieces for i in part]
        assert pieces[0][0] == 0 and {n for _, _, n in pieces} == {len(ids)}
        got.append((doc, ids))
    assert sorted(got) == want
    assert sorted(sequences) == list(range(len(sequences)))
    for number, parts in sequences.items():
        at = 0
        for offset, length, tokens in sorted(parts):
            assert offset == at
            at += length
        assert at == tokens and (at == window or number == len(sequences) - 1)


@pytest.mark.parametrize("window", [7, 2048])
def test_pack(spark, plain, window):
    docs = documents(spark, ODD_ROWS).repartition(3).withColumn("part", F.lit("x")).withColumn("ids", F.lit(1))
    check_pieces(packing.pack(docs, window=window).collect(), ODD_ROWS, plain, window)


def test_pack_nothing(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_op4(spark, plain):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_packing"](spark, SF).collect()
    covered = {}
    for r in rows:
        ids = (plain(docs[r["doc_id"]]) + [1])[r["start"]:r["start"] + r["length"]]
        assert crc(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == len(plain(docs[r["doc_id"]])) + 1
    assert covered == {d: len(plain(t)) + 1 for d, t in docs.items()}


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_token_files_round_trip(spark, plain, dtype):
    docs = documents(spark, ODD_ROWS).repartition(3).withColumn("name", F.lit("x"))
    folder = token_files.write_token_files(docs, dtype=dtype)
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in ODD_ROWS), key=lambda d: (d is not None, d))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    got = sorted((str(r["doc_id"]), np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in rows)
    assert got == sorted((str(d), plain(t) + [2]) for d, t in ODD_ROWS)


def test_token_files_of_nothing(spark):
    folder = token_files.write_token_files(documents(spark, []))
    assert token_files.read_token_files(spark, folder).count() == 0


def test_op5(spark, plain):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op5_token_files"](spark, SF).collect()}
    start = 0
    for doc, text in docs:
        ids = plain(text) + [2]
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


@pytest.fixture(scope="module")
def wide_vocabulary(tmp_path_factory):
    """70,000 words by spaces: ids above 65,535, and no rule by which words could be encoded apart."""
    import json

    path = tmp_path_factory.mktemp("vocabulary") / "words.json"
    path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"},
                                "post_processor": None, "decoder": None, "truncation": None, "padding": None, "model": {
                                    "type": "WordLevel", "unk_token": "w0", "vocab": {f"w{i}": i for i in range(70_000)}}}))
    return str(path)


def test_wide_vocabularies(spark, wide_vocabulary):
    docs = documents(spark, [(1, "w5 w69999 nothing"), (2, ""), (3, "w65536")]).repartition(2)
    assert encoder(wide_vocabulary).dtype == np.dtype("<u4") and not encoder(wide_vocabulary).by_word
    want = {1: [5, 69_999, 0, 1], 2: [1], 3: [65_536, 1]}
    assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in packing.pack(docs, vocabulary=wide_vocabulary).collect()} == want
    folder = token_files.write_token_files(docs, end_id=1, vocabulary=wide_vocabulary)
    got = token_files.read_token_files(spark, folder).collect()
    assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got} == want


@pytest.fixture
def many_shards(spark):
    """Small shuffles are not merged, as those of large tables would not be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shards_are_read_by_many_tasks(spark, many_shards):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    folder = token_files.write_token_files(docs)
    shards = token_files.read_manifest(spark, folder).count()
    rows = token_files.read_token_files(spark, folder).withColumn("task", F.spark_partition_id())
    assert shards > 1 and rows.select("task").distinct().count() >= 0.7 * shards and rows.count() == 4000


def test_hot_row_is_parted(spark, many_shards):
    """8,000 equal rows: ranges part them, and all come back."""
    docs = spark.range(9000).select(F.when(F.col("id") < 8000, 5).otherwise(F.col("id")).alias("doc_id"), F.when(
        F.col("id") < 8000, "the same").otherwise("other").alias("text"))
    folder = token_files.write_token_files(docs)
    sizes = [r["documents"] for r in token_files.read_manifest(spark, folder).collect()]
    assert sum(sizes) == 9000 and max(sizes) < 4000
    got = token_files.read_token_files(spark, folder)
    assert got.count() == 9000 and got.where("doc_id = 5").count() == 8000


def test_memory_keeps_frequent_words():
    from corpusmill.llm.bpe import Encoder

    small = Encoder(default_vocabulary(), max_words=50)
    for start in range(0, 3000, 100):
        texts = [f"the word{i} is here" for i in range(start, start + 100)]
        for text, ids in zip(texts, small.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert len(small.words.new) + len(small.words.old) < 500 and "here" in {**small.words.old, **small.words.new}
