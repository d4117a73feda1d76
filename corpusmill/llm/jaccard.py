"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its word shingles. XOR-ing the hashes into
blocks makes a sketch: two sketches differ in no more blocks (or bits) than the
sets differ in elements. Sets of Jaccard at least t and sizes s, u differ in at most
(1 - t) / (1 + t) * (s + u) = d elements; so of m > d blocks at least m - d are equal, and
among the d + 1 first blocks of each, in any order fixed for all, one is common.
Blocks are joined per band of sizes on those first blocks; the order puts blocks
with few rare shingles last, so that passages shared by many documents bring no
candidates unless a document holds little else. Candidates whose bit sketches
differ in more than d bits are dropped, the rest verified on the sets.

Equal sets are one class throughout. A block shared by few classes gives all their
pairs; one shared by many gives a star around one of them, and after the stars'
links are known, what is left between different components is compared block by
block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil, floor

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.graph import components
from corpusmill.llm.stores import prepare, stored

FEW = 16              # classes of a block that are paired directly
HEAVY = 1 << 15       # shingles in a task's, and twice as many in the common, list of frequent ones
CHUNK = 1 << 18       # hashes or block keys gathered in a task before they are sorted
SEEN = 1 << 18        # classes a task remembers, so as to send each once
BUCKET_KEYS = 600_000
STAR = 256           # partners that share one copy of a set when pairs are verified
TILE = 1024           # classes compared at once in a block shared by many
SMALL_SIDE = 4_000_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Rule:
    """``words`` per shingle; sets link at ``num / den`` of their union."""

    words: int = 5
    num: int = 75
    den: int = 100

    def links(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def differ(self, a: int, b: int) -> int:
        """Most elements in which linked sets of sizes ``a`` and ``b`` differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def partner(self, n: int) -> int:
        """Size of the largest set that links with one of size ``n``."""
        return n * self.den // self.num


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _Q
    return h ^ (h >> np.uint64(29))


class _Words(dict):
    """Hashes of words, kept while they are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text.

    Words are runs of other bytes than white space, with A-Z in lower case. Fewer
    than ``k`` words are one shingle; no words, none.
    """
    words = (text or "").encode().lower().split()  # of bytes: ASCII case and white space only
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(_words.__getitem__, words), "u8", len(words))
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], "u8")
    out = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _P + h[i:len(h) - k + 1 + i]
    return np.unique(_mix(out))


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


@cache
def band_start(rule: Rule, number: int) -> int:
    """Smallest size in a band; linked sets lie in the same band or in neighbours."""
    size = 1
    for _ in range(number):
        size = rule.partner(size) + 1
    return size


@cache
def band_of(rule: Rule, n: int) -> int:
    number = 0
    while band_start(rule, number + 1) <= n:
        number += 1
    return number


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set, about four per element: their Hamming distance is at most
    the number of elements in which two sets differ, also after :func:`fold`."""
    size = 64 << max(0, ceil(np.log2(max(1, len(s)) / 16)))
    bits = np.bincount((s >> np.uint64(20)).astype("i8") & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype("u1"), bitorder="little").tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of words, halved by XOR until it has ``size`` words."""
    while len(sketch) > size:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def block_keys(s: np.ndarray, heavy: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of the blocks on which a set must meet each set that it links with.

    ``heavy``: for each element, whether it is in the common list of frequent ones.
    """
    n, own, out = len(s), band_of(rule, len(s)), []
    for band in (own, own + 1):  # where it is of the larger, and of the smaller band
        last = band_start(rule, band + 1) - 1
        # how many blocks there are does not change how many are needed; about one element a
        # block leaves enough of rare shingles beside a long shared passage
        blocks = last if last >= 100 else 4 * last
        need = rule.differ(n, min(last, rule.partner(n))) + 1
        at = ((s >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype("i8")
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        words = np.bitwise_xor.reduceat(_mix(s[order] * _P), first)
        rare = np.add.reduceat((~heavy[order]).astype("i8"), first)
        key = _mix(words + _mix(used.astype("u8") * _P + np.uint64(band + 1)))
        if len(used) < need:  # empty blocks come last
            empty = np.setdiff1d(np.arange(blocks), used, assume_unique=True)
            key = np.append(key, _mix(_mix(empty.astype("u8") * _P + np.uint64(band + 1))))
            rare = np.append(rare, np.full(len(empty), -1))
        out.append(key[np.lexsort((key, -rare))[:need]])
    return np.concatenate(out)


class _Frequent:
    """A bounded summary of the most frequent hashes: none above 1 / HEAVY of all is missed."""

    def __init__(self):
        self.hashes, self.counts = np.zeros(0, "u8"), np.zeros(0, "i8")
        self.waiting, self.held = [], 0

    def add(self, s: np.ndarray) -> None:
        self.waiting.append(s)
        self.held += len(s)
        if self.held >= CHUNK:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        h, n = np.unique(np.concatenate(self.waiting), return_counts=True)
        h, n = h[n > 1], n[n > 1]
        every, back = np.unique(np.concatenate([self.hashes, h]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([self.counts, n]), len(every)).astype("i8")
        if len(every) > HEAVY:
            cut = np.partition(counts, len(counts) - HEAVY - 1)[len(counts) - HEAVY - 1]
            keep = counts > cut
            every, counts = every[keep], counts[keep] - cut
        self.hashes, self.counts, self.waiting, self.held = every, counts, [], 0


STATS = "doc_id bigint, class bigint, n bigint, sketch binary, hash bigint, times bigint"


def set_table(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row per document (doc_id, class, n, sketch), and rows (hash, times) of frequent
    shingles of each task; stored. A class seen before in the task has a null sketch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, seen = _Frequent(), set()
        for batch in batches:
            rows = []
            for doc, text in batch[["doc_id", "text"]].itertuples(index=False):
                s = shingles(text, rule.words)
                name, new = class_of(s), False
                if len(s):
                    new = name not in seen
                    if new:
                        frequent.add(s)
                        if len(seen) < SEEN:
                            seen.add(name)
                rows.append((doc, name, len(s), bit_sketch(s) if new else None, None, None))
            yield _stats(rows)
        frequent.merge()
        yield _stats([(None, None, None, None, h, n) for h, n in
                      zip(frequent.hashes.view("i8").tolist(), frequent.counts.tolist(), strict=True)])

    return stored(docs.select("doc_id", "text").mapInPandas(run, STATS), "sets")


def _stats(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "class", "n", "sketch", "hash", "times"])
    return out.astype({c: "Int64" for c in ("doc_id", "class", "n", "hash", "times")})


PACKED = "bucket long, kind int, xs binary, ys binary"


def _pairs_of(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From (key, class) entries: candidate pairs, then the entries of keys of many classes.

    A key of up to FEW classes gives all pairs, one of more a star around the class
    that a hash of key and class puts first.
    """
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    if not len(keys):
        return names, names, keys, names
    new = np.append(True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]))
    keys, names = keys[new], names[new]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    length = np.diff(np.append(start, len(keys)))
    a, b = [], []
    few = np.repeat((length > 1) & (length <= FEW), length)
    for step in range(1, FEW):  # pairs a fixed distance apart in the runs of few
        left = np.flatnonzero(few[:-step] & (keys[:-step] == keys[step:])) if step < len(keys) else np.zeros(0, "i8")
        a.append(names[left])
        b.append(names[left + step])
    many = np.flatnonzero(np.repeat(length > FEW, length))
    mk, mn = keys[many], names[many]
    if len(mk):
        order = np.lexsort((_mix(mn.view("u8") ^ mk), mk))
        head = np.append(True, mk[order][1:] != mk[order][:-1])
        pivot = mn[order][head][np.cumsum(head) - 1]
        away = mn[order] != pivot
        a.append(np.minimum(pivot, mn[order])[away])
        b.append(np.maximum(pivot, mn[order])[away])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    return a[fresh], b[fresh], mk, mn


def _packed(bucket: int, kind: int, xs: np.ndarray, ys: np.ndarray) -> pd.DataFrame:
    step = 1 << 19
    rows = [(bucket, kind, xs[i:i + step].tobytes(), ys[i:i + step].tobytes()) for i in range(0, len(xs), step)]
    return pd.DataFrame(rows, columns=["bucket", "kind", "xs", "ys"])


def _by_bucket(kind: int, keys: np.ndarray, names: np.ndarray, bucket: np.ndarray) -> pd.DataFrame:
    order = np.argsort(bucket, kind="stable")
    keys, names, bucket = keys[order], names[order], bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(keys)]
    return pd.concat([_packed(int(bucket[i]), kind, keys[i:j], names[i:j])
                      for i, j in zip(cuts[:-1], cuts[1:], strict=True)])


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    xs = np.frombuffer(b"".join(map(bytes, frame["xs"])), "<u8")
    return xs, np.frombuffer(b"".join(map(bytes, frame["ys"])), "<i8")


def candidates(docs: DataFrame, frequent: np.ndarray, keys: int, rule: Rule) -> DataFrame:
    """Packed candidate pairs of classes (kind 1) and entries of keys of many classes (kind 2); stored."""
    buckets = max(1, -(-keys // BUCKET_KEYS))
    context = docs.sparkSession.sparkContext
    known = np.sort(frequent)
    table = np.zeros(1 << 20, bool)
    table[(known >> np.uint64(44)).astype("i8")] = True
    shared = context.broadcast((known, table))  # HEAVY * 2 hashes at most

    def spread(keys: np.ndarray, names: np.ndarray, home: int) -> Iterator[pd.DataFrame]:
        """Entries by bucket; a key of many classes in this chunk is dealt with here, but for its first class."""
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        # a class that the task no longer remembers comes again with each of its documents
        new = np.append(True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]))
        keys, names = keys[new], names[new]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        length = np.diff(np.append(start, len(keys)))
        large = np.repeat(length > 4 * FEW, length)
        bucket = ((keys >> np.uint64(24)) % np.uint64(buckets)).astype("i8")
        if large.any():
            a, b, mk, mn = _pairs_of(keys[large], names[large])
            yield _packed(home % buckets, 1, a.view("u8"), b)
            yield _packed(home % buckets, 2, mk, mn)
            mark = start[large[start]]
            yield _by_bucket(3, keys[mark], names[mark], bucket[mark])
            large[start] = False  # one class stands for the others in the bucket
            keys, names, bucket = keys[~large], names[~large], bucket[~large]
        yield _by_bucket(0, keys, names, bucket)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, table = shared.value
        seen, keys, names, held, home = set(), [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for text in batch["text"]:
                s = shingles(text, rule.words)
                name = class_of(s)
                if not len(s) or name in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                heavy = table[(s >> np.uint64(44)).astype("i8")]
                if heavy.any():
                    maybe = s[heavy]
                    place = np.minimum(np.searchsorted(known, maybe), len(known) - 1)
                    heavy[heavy] = known[place] == maybe
                mine = block_keys(s, heavy, rule)
                keys.append(mine)
                names.append(np.full(len(mine), name, "i8"))
                held += len(mine)
                if held >= CHUNK:
                    yield from spread(np.concatenate(keys), np.concatenate(names), home)
                    keys, names, held, home = [], [], 0, home + 1
        if held:
            yield from spread(np.concatenate(keys), np.concatenate(names), home)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        bucket, own, marks = int(frame["bucket"].iloc[0]), frame["kind"] == 0, frame["kind"] == 3
        keys, names = _unpacked(frame[own])
        a, b, mk, mn = _pairs_of(keys, names)
        out = [_packed(bucket, 1, a.view("u8"), b), _packed(bucket, 2, mk, mn), frame[~own & ~marks]]
        if marks.any():  # keys of many classes in some chunk: their other entries join those
            also = np.isin(keys, _unpacked(frame[marks])[0])
            out.append(_packed(bucket, 2, keys[also], names[also]))
        return pd.concat(out)

    found = docs.select("text").where(F.col("text").isNotNull()).mapInPandas(emit, PACKED)
    return stored(found.groupBy("bucket").applyInPandas(meet, PACKED), "candidates")


def _exploded(packed: DataFrame, kind: int, x: str, y: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs, ys = _unpacked(batch)
            yield pd.DataFrame({x: xs.view("i8"), y: ys})

    return packed.where(F.col("kind") == kind).select("xs", "ys").mapInPandas(run, f"{x} long, {y} long")


def _may_link(rule: Rule):
    """Keeps pairs (a, b) whose sizes and sketches leave the link possible."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for n, m, x, y in batch[["n_a", "n_b", "sketch_a", "sketch_b"]].itertuples(index=False):
                most = rule.differ(n, m)
                if abs(n - m) <= most:
                    p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    size = min(len(p), len(q))
                    keep.append(int(np.bitwise_count(fold(p, size) ^ fold(q, size)).sum()) <= most)
                else:
                    keep.append(False)
            yield batch.loc[keep, ["a", "b"]]

    return run


def _with_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("class").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)),
                           side)
    return pairs


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets link; stored.

    The sets are computed again from one document of each class and sent to their
    pairs: for each ``a``, up to STAR partners share one copy of its set.
    """
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    salted = pairs.join(stars, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    wanted = salted.select("a", "salt", F.col("b").alias("class")).union(
        salted.select("a", "salt", "a").distinct())
    wanted = stored(wanted.join(classes.select("class", F.col("doc_id").alias("of_id")), "class"), "wanted")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at:at + 512]
                found = [shingles(t, rule.words) for t in some["text"]]
                own = np.array([class_of(s) for s in found], "i8") == some["class"].to_numpy()  # ids may repeat
                yield pd.DataFrame({"a": some["a"], "salt": some["salt"], "class": some["class"],
                                    "elements": [s.tobytes() for s in found]})[own]

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        a, out = int(frame["a"].iloc[0]), []
        sets = {int(c): np.frombuffer(e, "<u8") for c, e in frame[["class", "elements"]].itertuples(index=False)}
        first = sets.pop(a)
        for name, s in sets.items():
            both = np.concatenate([first, s])
            both.sort()
            if rule.links(int((both[1:] == both[:-1]).sum()), len(first), len(s)):
                out.append((a, name))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    known, unknown = wanted.where("of_id IS NOT NULL"), wanted.where("of_id IS NULL")
    if known.count() <= SMALL_SIDE:  # four numbers a row; above that the join is dealt by id
        known = F.broadcast(known)
    text = docs.select(F.col("doc_id").alias("of_id"), "text")
    ready = text.where("of_id IS NOT NULL").join(known, "of_id").select("a", "salt", "class", "text")
    schema = "a long, salt int, class long, elements binary"
    ready = ready.mapInPandas(sets, schema)
    if not unknown.isEmpty():  # classes that only documents without an id have are found by their name
        named = text.where("of_id IS NULL").select("text").mapInPandas(_named(rule), "class long, elements binary")
        ready = ready.union(named.join(unknown, "class").select("a", "salt", "class", "elements"))
    return stored(ready.groupBy("a", "salt").applyInPandas(check, "a long, b long"), "links")


def _named(rule: Rule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, rule.words) for t in batch["text"]]
            yield pd.DataFrame({"class": [class_of(s) for s in sets], "elements": [s.tobytes() for s in sets]})

    return run


def _leftover(entries: DataFrame, found: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs in blocks of many classes that lie in different components and may link.

    Of blocks with the same classes one is enough. The classes of a large block are
    dealt into tiles, two of which are compared at a time; small blocks are compared many to a
    task. Only pairs that pass the sketch test leave it.
    """
    placed = (entries.distinct().join(found.withColumnRenamed("node", "class"), "class", "left")
              .withColumn("component", F.coalesce("component", "class")))
    placed = stored(placed, "placed")
    mixed = (placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                       F.count("*").alias("members"), F.bit_xor(F.xxhash64("class")).alias("mark"))
             .where("x <> y").groupBy("mark", "members", "x", "y").agg(F.min("key").alias("key")))
    groups = max(1, placed.count() // (16 * TILE))
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    home = F.when(tiles > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups)))
    dealt = (placed.join(mixed.select("key", tiles.alias("tiles"), home.alias("home")), "key")
             .withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")))
    # each tile goes to the pairs of tiles that it is part of
    to = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                               lambda t: F.struct(F.least(t, "tile").alias("i"), F.greatest(t, "tile").alias("j"))))
    rows = dealt.select("key", "home", "class", "component", "tile", to.alias("to")).select(
        "key", "home", "class", "component", "tile", "to.i", "to.j").join(classes.select("class", "n", "sketch"), "class")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        keys, n, name, comp, tile = (frame[c].to_numpy() for c in ("key", "n", "class", "component", "tile"))
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        sketches = [np.frombuffer(x, "<u8") for x in frame["sketch"]]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(keys)]
        a, b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            size = min(len(s) for s in sketches[first:end])
            bits = np.stack([fold(s, size) for s in sketches[first:end]])
            own = slice(first, end)
            n_, name_, comp_ = n[own], name[own], comp[own]
            left, right = np.flatnonzero(tile[own] == i), np.flatnonzero(tile[own] == j)
            for x in left:
                near = right[right > x] if i == j else right
                most = (rule.den - rule.num) * (n_[x] + n_[near]) // (rule.den + rule.num)
                ok = (np.abs(n_[x] - n_[near]) <= most) & (comp_[x] != comp_[near])
                near = near[ok]
                if len(near):
                    near = near[np.bitwise_count(bits[near] ^ bits[x]).sum(axis=1) <= most[ok]]
                    a.append(np.minimum(name_[x], name_[near]))
                    b.append(np.maximum(name_[x], name_[near]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return rows.groupBy("home", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def link_classes(docs: DataFrame, rule: Rule | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n) of every document, and (node, component) of the linked classes."""
    rule = rule or Rule()
    prepare(docs.sparkSession)
    stats = set_table(docs, rule)
    of_docs = stats.where(F.col("class").isNotNull())
    total = of_docs.agg(F.sum("n")).first()[0] or 0
    frequent = (stats.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.sum("times").alias("times"))
                .where(F.col("times") > FEW).orderBy(F.desc("times"), "hash").limit(2 * HEAVY).select("hash").collect())
    heavy = np.array([r["hash"] for r in frequent], "i8").view("u8")
    packed = candidates(docs, heavy, int(total * 0.6), rule)
    # one row per class: a document that has it, its size and its sketch
    classes = stored(of_docs.where("n > 0").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n"),
        F.max("sketch").alias("sketch")), "classes")
    pairs = _exploded(packed, 1, "a", "b").distinct()
    maybe = stored(_with_sides(pairs, classes, "n", "sketch").mapInPandas(_may_link(rule), "a long, b long"), "maybe")
    # the link to the smallest partner of each class first: most pairs then lie in one component already
    first = maybe.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verified(first, docs, classes, rule)
    found = components(links)
    links = links.unionByName(_verified(_apart(maybe, found), docs, classes, rule))
    entries = _exploded(packed, 2, "key", "class")
    if not entries.isEmpty():
        found = stored(components(links), "components")
        more = stored(_leftover(entries, found, classes, rule), "leftover")
        links = links.unionByName(_verified(more, docs, classes, rule))
    return of_docs.select("doc_id", "class", "n"), stored(components(links), "components")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that lie in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    return pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def jaccard_components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) of every document.

    ``component_id`` is the smallest id reachable by links, the document's own
    included; documents of equal sets are linked. A null or empty text, or one of
    white space, has an empty set and links with nothing. Rows with a null id take
    part: they connect others, and their component is the smallest id it has, or
    null. Repeated rows are copies of one another. No documents give no rows. Other
    columns are not read. Set names and shingles are 64-bit hashes.
    """
    of_docs, found = link_classes(docs, rule)
    linked = (of_docs.join(found.withColumnRenamed("node", "class"), "class", "left")
              .withColumn("component", F.coalesce("component", "class")))
    # stored, so that the join deals its sides anew and can split a component of very many documents
    least = stored(linked.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    return linked.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "class")
