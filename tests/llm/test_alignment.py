"""Token alignment against a plain version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpusmill.llm import alignment
from corpusmill.llm.catalog import QUERIES
from helpers import ODD_ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = letters()


def a_bytes(i):
    return bytes(LETTERS[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """Groups (A ids, B ids) of a text."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    want = (" " + text).encode()
    if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
        return []
    ends_a, ends_b = np.cumsum([len(a_bytes(i)) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()
    groups, pa, pb = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        qa, qb = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[pa:qa], b[pb:qb]))
        pa, pb = qa, qb
    return groups


def expected(rows):
    groups = [(d, plain(t)) for d, t in rows]
    count = Counter((x[-1], y[-1]) for _, g in groups for x, y in g)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for d, g in groups:
        links = [(x[-1], y[-1]) for x, y in g]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                    sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out, count


ODD = [*ODD_ROWS, (13, "mark ▁ inside"), (14, "<0x41> <s> </s> <unk>"), (15, "a\x00b"), (16, " two  spaces "),
       (17, "ﬁ ½ Å é"), (18, "é" * 300)]


def key(row):
    return tuple((v is not None, v) for v in row)


def test_align_counts(spark):
    docs = documents(spark, ODD).repartition(3).withColumn("slot", F.lit(1)).withColumn("sums", F.lit("x"))
    got = [tuple(r) for r in alignment.align_counts(docs).collect()]
    assert sorted(got, key=key) == sorted(expected(ODD)[0], key=key)


def test_link_table(spark):
    got = {(r["a_id"], r["b_id"]): r["n"] for r in alignment.link_table(documents(spark, ODD)).collect()}
    assert got == expected(ODD)[1]


def test_groups_and_overlaps(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: r["groups"] for r in alignment.align(documents(spark, rows)).collect()}
    for doc, text in rows:
        assert [(g["a"], g["b"]) for g in got[doc]] == plain(text)
        at = 0
        for g in got[doc]:
            assert g["start"] == at
            spans_a, spans_b = [], []
            for ids, spell, spans in ((g["a"], a_bytes, spans_a), (g["b"], b_bytes, spans_b)):
                to = at
                for i in ids:
                    spans.append((to, to := to + len(spell(i))))
                assert to == g["stop"]
            want = [[k for k, (s, e) in enumerate(spans_b) if s < stop and e > start] for start, stop in spans_a]
            assert [(o["first"], o["last"]) for o in g["overlaps"]] == [(w[0], w[-1]) for w in want]
            at = g["stop"]


def test_nothing(spark):
    assert alignment.align_counts(documents(spark, [])).count() == 0
    assert alignment.align(documents(spark, [])).count() == 0
    assert [r["n_links"] for r in alignment.align_counts(documents(spark, [(1, None)])).collect()] == [0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\xa0ab,.1é漢'<|>▁s", max_size=30), min_size=1, max_size=5))
def test_texts(texts):
    own = alignment.aligner()
    found = own.align(texts)
    want = [plain(t) for t in texts]
    assert np.diff(found.cuts_at).tolist() == [len(g) for g in want]
    assert [w.decode() for w in own.written(found)] == [
        ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for g in want]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1), st.lists(st.integers(0, 300)), st.integers(-5, 400))
def test_gallop(values, wanted, guess):
    long = np.array(sorted(values))
    short = np.array(sorted(v for v in wanted if v <= long[-1]), "i8")
    got = alignment.gallop(short, long, np.full(len(short), guess))
    assert got.tolist() == np.searchsorted(long, short).tolist()


def test_op11(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = QUERIES["op11_alignment"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows)[0])


@pytest.mark.parametrize("sizes", [(1, 50), (50, 1), (40, 40)])
def test_either_side_may_be_shorter(sizes):
    own = alignment.aligner()
    texts = ["a" * sizes[0], "漢" * sizes[1], "the quick brown fox " * 3 + "x"]
    found = own.align(texts)
    assert np.diff(found.cuts_at).tolist() == [len(plain(t)) for t in texts]
