"""Ranked lexical search: Block-Max MaxScore over compressed posting lists.

Documents are indexed where they lie, in shards of bounded text. A shard has one row
per term: its posting list in blocks of 128, each with its first document, the
highest impact in it and its bytes, so a block can be judged without being unpacked.
A shard answers a block of questions at once and keeps each question's best k; the
heaps of the shards are merged.

Within a shard, lists are ordered by their highest possible contribution. Those whose
contributions together stay below the k-th best score so far are not essential: no
document is found through them alone. Documents of the essential lists are candidates;
along the other lists, a candidate is dropped as soon as its score and the bounds of
what is left (for the next list, the maximum of the block it would be in) stay below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.stores import prepare, stored
from corpusmill.operators.topk import top_k

BLOCK = 128
SHARD_DOCS, SHARD_CHARACTERS = 1 << 15, 16_000_000
WINDOW = 4096
ITEMS = 64                      # questions that a shard answers at once
DOCUMENTS = ""                  # no term: the row of a shard's document ids and lengths
INDEX = "shard bigint, term string, df bigint, payload binary"
HITS = "question bigint, doc_id bigint, score bigint"
HEADER = np.dtype([("first", "<u2"), ("top", "<u4"), ("size", "<u2")])
LONG_STEPS, LONG_COUNTS = 1 << 15, 1 << 14   # marks in ``size``: wide steps, wide counts
# ASCII other than letters and digits ends a term; A-Z become a-z; all other bytes are kept
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def fold(text: str) -> bytes:
    """The terms of a text, lower-cased (A-Z only), with spaces between them."""
    return text.encode().translate(_FOLD)


def impact(tf, m):
    """What an occurrence count is worth in a document of relative length ``m``, in whole numbers."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def relative_length(n, documents: int, terms: int):
    """A document's ``m``: half of it in proportion to its number of terms ``n``."""
    return 50 + 50 * n * documents // max(terms, 1)


@dataclass
class Index:
    """Posting lists of all shards (stored), and the number of documents with terms and of terms."""

    lists: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame) -> Index:
    """Index the whole texts of ``docs`` (``doc_id``, ``text``).

    Two passes over the texts: the first counts documents and terms (two numbers a task),
    which the impacts need; the second writes the lists. Texts without a term are not
    indexed. Repeated and null ids are documents of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = terms = 0
        for batch in batches:
            for text in batch["text"]:
                n = len(fold(text).split())
                seen, terms = seen + (n > 0), terms + n
        yield pd.DataFrame({"documents": [seen], "terms": [terms]})

    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    total = (texts.select("text").mapInPandas(count, "documents bigint, terms bigint")
             .agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first())
    documents, terms = int(total["documents"] or 0), int(total["terms"] or 0)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, ids, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype("Int64").tolist(), batch["text"], strict=True):
                if held and (len(held) == SHARD_DOCS or size + len(text) > SHARD_CHARACTERS):
                    yield from _shard(number, ids, held, documents, terms)
                    number, held, ids, size = number + 1, [], [], 0
                held.append(fold(text))
                ids.append(None if doc is pd.NA else doc)
                size += len(text)
        if held:
            yield from _shard(number, ids, held, documents, terms)

    return Index(stored(texts.mapInPandas(write, INDEX), "index"), documents, terms)


def _shard(number: int, ids: list, folded: list[bytes], documents: int, terms: int) -> Iterator[pd.DataFrame]:
    """The rows of one shard."""
    words = pc.ascii_split_whitespace(pa.array(folded, pa.large_binary()).cast(pa.large_string()))
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    names, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy().astype("i8")
    doc = np.repeat(np.arange(len(folded)), sizes)
    real = (names != "")[code]           # a leading space makes an empty word
    code, doc = code[real], doc[real]
    n = np.bincount(doc, minlength=len(folded)).astype("i8")
    key, tf = np.unique(code * len(folded) + doc, return_counts=True)
    code, doc = key // len(folded), key % len(folded)
    m = relative_length(n, documents, terms)
    lists, first_of = np.unique(code, return_index=True)
    payloads, df = pack(doc, tf.astype("i8"), impact(tf.astype("i8"), m[doc]), first_of)
    names = names[lists]
    null = np.array([i is None for i in ids])
    own = np.array([i or 0 for i in ids], "<i8").tobytes() + m.astype("<i8").tobytes() + null.tobytes()
    yield pd.DataFrame({"shard": [number], "term": [DOCUMENTS], "df": [len(ids)], "payload": [own]})
    for at in range(0, len(names), 20_000):
        to = at + 20_000
        yield pd.DataFrame({"shard": number, "term": names[at:to], "df": df[at:to], "payload": payloads[at:to]})


def pack(doc: np.ndarray, tf: np.ndarray, worth: np.ndarray, first_of: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Posting lists as bytes, and their lengths.

    All lists lie one after another, in order of document within each, and begin at ``first_of``.
    A list is its blocks' headers, then its blocks: steps between documents (one byte each, or two),
    then occurrence counts (one byte each, or four).
    """
    if not len(doc):
        return [], np.zeros(0, "i8")
    df = np.diff(np.append(first_of, len(doc)))
    rank = np.arange(len(doc)) - np.repeat(first_of, df)
    begins = np.flatnonzero(rank % BLOCK == 0)               # of blocks
    count = np.diff(np.append(begins, len(doc)))
    block = np.repeat(np.arange(len(begins)), count)
    step = np.diff(doc, prepend=0)
    step[begins] = 0
    wide_step, wide_tf = np.maximum.reduceat(step, begins) > 255, np.maximum.reduceat(tf, begins) > 255
    step_bytes, tf_bytes = np.where(wide_step, 2, 1), np.where(wide_tf, 4, 1)
    size = (count - 1) * step_bytes + count * tf_bytes
    list_of = np.repeat(np.arange(len(df)), -(-df // BLOCK))
    blocks_of = -(-df // BLOCK)
    length = HEADER.itemsize * blocks_of + np.add.reduceat(size, np.cumsum(blocks_of) - blocks_of)
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), "u1")
    header = np.zeros(len(begins), HEADER)
    header["first"], header["top"] = doc[begins], np.maximum.reduceat(worth, begins)
    header["size"] = size + np.where(wide_step, LONG_STEPS, 0) + np.where(wide_tf, LONG_COUNTS, 0)
    in_list = np.arange(len(begins)) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of)
    at = start[list_of] + HEADER.itemsize * in_list
    out[(at[:, None] + np.arange(HEADER.itemsize)).ravel()] = header.view("u1")
    before = np.cumsum(size) - size
    body = start[list_of] + HEADER.itemsize * blocks_of[list_of] + before - before[np.cumsum(blocks_of) - blocks_of][list_of]
    place = np.arange(len(doc)) - begins[block]
    for values, width, most, origin, chosen in (
            (step, step_bytes, 2, body[block] + (place - 1) * step_bytes[block], place > 0),
            (tf, tf_bytes, 4, body[block] + ((count - 1) * step_bytes)[block] + place * tf_bytes[block], place >= 0)):
        for k in range(most):
            mine = chosen & (width[block] > k)
            out[origin[mine] + k] = values[mine] >> 8 * k & 255
    raw, cut = out.tobytes(), np.append(start, len(out)).tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], df


@dataclass
class Postings:
    """One list of a shard; blocks are unpacked when they are asked for."""

    payload: bytes
    df: int
    m: np.ndarray
    head: np.ndarray = field(init=False)
    unpacked: dict = field(default_factory=dict)

    def __post_init__(self):
        blocks = -(-self.df // BLOCK)
        self.head = np.frombuffer(self.payload, HEADER, blocks)
        self.size = self.head["size"].astype("i8") & (LONG_COUNTS - 1)
        self.begin = HEADER.itemsize * blocks + np.cumsum(self.size) - self.size
        self.first, self.top = self.head["first"].astype("i8"), self.head["top"].astype("i8")

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if b not in self.unpacked:
            mark, count = int(self.head["size"][b]), min(BLOCK, self.df - b * BLOCK)
            steps = np.frombuffer(self.payload, "<u2" if mark & LONG_STEPS else "u1", count - 1, self.begin[b])
            tf = np.frombuffer(self.payload, "<u4" if mark & LONG_COUNTS else "u1", count, self.begin[b] + steps.nbytes)
            docs = self.first[b] + np.concatenate([[0], np.cumsum(steps, dtype="i8")])
            self.unpacked[b] = docs, impact(tf.astype("i8"), self.m[docs])
        return self.unpacked[b]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` to before ``high``, and their impacts."""
        start = max(int(np.searchsorted(self.first, low, "right")) - 1, 0)
        some = [self.block(b) for b in range(start, int(np.searchsorted(self.first, high)))]
        if not some:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        docs, worth = (np.concatenate(c) for c in zip(*some, strict=True))
        inside = slice(*np.searchsorted(docs, [low, high]))
        return docs[inside], worth[inside]


def best_of_shard(lists: list[tuple[int, Postings]], ids: np.ndarray, k: int, window: int = WINDOW,
                  seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of the highest scores (all above 0, if fewer) and their scores.

    ``lists``: weight and postings of each term; ``ids``: what breaks ties, smaller first.
    ``seen`` counts candidates and those rejected before their block was unpacked.
    """
    lists = sorted((p for p in lists if p[0] > 0), key=lambda p: (p[0] * int(p[1].top.max()), p[1].df))
    bounds = np.cumsum([0] + [w * int(p.top.max()) for w, p in lists])   # of the first j lists together
    docs, scores, least = np.zeros(0, "i8"), np.zeros(0, "i8"), 0
    for low in range(0, len(ids), window):
        # the first ``rest`` lists alone cannot reach the k-th score; an equal one may win by its id
        rest = int(np.searchsorted(bounds, least, "left")) - 1 if least else 0
        rest = max(rest, 0)
        if rest == len(lists):
            break
        sums = np.zeros(window, "i8")
        for weight, postings in lists[rest:]:
            at, worth = postings.between(low, low + window)
            sums[at - low] += weight * worth
        found = np.flatnonzero(sums)
        score, found = sums[found], found + low
        for j in range(rest - 1, -1, -1):
            weight, postings = lists[j]
            keep = score + bounds[j + 1] >= least
            found, score = found[keep], score[keep]
            block = np.searchsorted(postings.first, found, "right") - 1
            top = np.where(block >= 0, postings.top[np.maximum(block, 0)], 0)
            keep = score + weight * top + bounds[j] >= least
            if seen is not None:
                seen["candidates"] = seen.get("candidates", 0) + len(keep)
                seen["rejected"] = seen.get("rejected", 0) + int((~keep).sum())
            found, score, block = found[keep], score[keep], block[keep]
            for b in np.unique(block[block >= 0]).tolist():
                mine = slice(*np.searchsorted(block, [b, b + 1]))
                at, worth = postings.block(b)
                place = np.minimum(np.searchsorted(at, found[mine]), len(at) - 1)
                score[mine] += np.where(at[place] == found[mine], weight * worth[place], 0)
        keep = (score >= max(least, 1))
        docs, scores = np.concatenate([docs, found[keep]]), np.concatenate([scores, score[keep]])
        if len(docs) > k:
            order = np.lexsort([ids[docs], -scores])[:k]
            docs, scores = docs[order], scores[order]
        if len(docs) == k:
            least = int(scores.min())
    return docs, scores


def _answer(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        is_docs = rows["term"] == DOCUMENTS
        raw = rows.loc[is_docs, "payload"].iloc[0]
        n = int(rows.loc[is_docs, "df"].iloc[0])
        ids, m = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
        null = np.frombuffer(raw, bool, n, 16 * n)
        ties = np.where(null, np.iinfo("i8").max, ids)   # null ids come last among equals
        questions: dict[int, list] = {}
        for df, payload, weight, asked in rows.loc[~is_docs, ["df", "payload", "weight", "questions"]].itertuples(index=False):
            postings = Postings(payload, int(df), m)
            for q in asked:
                questions.setdefault(int(q), []).append((int(weight), postings))
        out = []
        for q, lists in questions.items():
            docs, scores = best_of_shard(lists, ties, k)
            out.append(pd.DataFrame({"question": q, "doc_id": pd.Series(ids[docs], dtype="Int64").mask(null[docs]),
                                     "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in HITS.split(", ")})

    return run


def search(index: Index, items: DataFrame, k: int = 50, item: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item`` (its column), ``rank`` (from 1), ``doc_id``, ``score``.

    A term that ``df`` of N documents hold weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document's
    score sums weight times ``impact`` over the item's distinct terms. Ties go to smaller ids, null ids
    last. Items of equal id and text are one; equal ids with other texts are items of their own, ranked
    apart. Null texts, texts without a term, and items that no document matches have no rows. Other
    columns of the items are not read.

    Items go in blocks of about 64, so a shard and a block make one bounded group whatever their numbers.
    """
    spark = items.sparkSession
    prepare(spark)
    asked = stored(items.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("text"))
                   .distinct().withColumn("question", F.monotonically_increasing_id()), "questions")
    blocks = -(-asked.count() // ITEMS)

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(dict.fromkeys(fold(t).decode().split())))

    block = F.pmod(F.xxhash64("question"), F.lit(max(blocks, 1)))
    words = stored(asked.select("question", block.alias("block"), F.explode(terms("text")).alias("term")), "terms")
    wanted = words.select("term").distinct().union(spark.range(1).select(F.lit(DOCUMENTS)))
    lists = stored(index.lists.join(wanted, "term"), "lists")
    size = 2.0 * index.documents + 2
    weights = lists.groupBy("term").agg(F.sum("df").alias("all")).select(
        "term", F.floor(1000 * F.ln(F.lit(size) / (2.0 * F.col("all") + 1))).alias("weight"))
    # at most 64 questions or so meet in a term and block; each block also needs the rows of document ids
    needs = words.join(weights, "term").groupBy("block", "term", "weight").agg(
        F.collect_list("question").alias("questions")).unionByName(words.select("block").distinct().select(
            "block", F.lit(DOCUMENTS).alias("term"), F.lit(0).cast("bigint").alias("weight"),
            F.array().cast("array<bigint>").alias("questions")))
    rows = lists.join(needs, "term")
    hits = rows.groupBy("shard", "block").applyInPandas(_answer(k), HITS)
    best = top_k(hits.withColumn("salt", F.monotonically_increasing_id()), ["question"],
                 [F.desc("score"), F.asc_nulls_last("doc_id")], k, salt_on="salt")
    return best.join(asked.select("question", "item"), "question").select(
        F.col("item").alias(item), "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, item: str = "item_id") -> DataFrame:
    """Index ``docs`` and search them for ``items``."""
    return search(build_index(docs), items, k, item)
