"""Token alignment between two tokenizers over the same text.

The ends of both token lists are byte offsets in the same bytes. The shorter list
drives a galloping search into the longer; the common ends cut both lists into
groups, and rank differences between cuts give the tokens of a group and their
overlaps. A token pair that ends together is a link; as the shorter token's bytes
then end the longer's, all links that can ever occur are numbered from the two
vocabularies alone, and their counts are one bounded array.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.bpe import ByWord, default_vocabulary, encoder, piece_vocabulary, pieces, slices
from corpusmill.llm.stores import prepare, stored

GROUPS = ("row bigint, doc_id bigint, groups array<struct<a: array<int>, b: array<int>, start: bigint, stop: bigint, "
          "overlaps: array<struct<first: int, last: int>>>>")
DIGEST = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, slots binary, groups_sha256 string"
CHARACTERS = 500_000
WORDS = 150_000  # that each of the two encoders remembers, twice


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """First place in ``long`` whose value is not below each value of ``short``.

    Both ascend, and ``long`` ends at or above all of ``short``. Each element doubles
    its steps away from its guess until the place is bracketed, and halves the
    bracket; all elements move together, and those that are done drop out.
    """
    last = len(long) - 1
    low, high = np.clip(guess, 0, last), np.clip(guess, 0, last)
    below = long[low] < short            # the place is behind the guess, else at or before it
    active, step = np.flatnonzero(below), 1
    while len(active):                   # long[low] < short: move high on
        high[active] = np.minimum(low[active] + step, last)
        active = active[long[high[active]] < short[active]]
        low[active] = high[active]
        step *= 2
    active, step = np.flatnonzero(~below), 1
    while len(active):                   # long[high] >= short: move low down; -1 is below all
        low[active] = np.maximum(high[active] - step, -1)
        at = low[active]
        active = active[(at >= 0) & (long[at] >= short[active])]
        high[active] = low[active]
        step *= 2
    active = np.flatnonzero(high - low > 1)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        up = long[middle] < short[active]
        low[active[up]] = middle[up]
        high[active[~up]] = middle[~up]
        active = active[high[active] - low[active] > 1]
    return high


class Spelling:
    """The bytes of a vocabulary's ids, as flat tables."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], "i8")
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), "u1")
        digits = [str(i).encode() for i in range(len(tokens))]
        self.digits = np.array([len(d) for d in digits], "i8")
        self.width = int(self.digits.max(initial=1)) + 1
        # the id in decimal digits, and room for a separator
        self.decimal = np.frombuffer(b"".join(d.ljust(self.width) for d in digits), "u1").reshape(-1, self.width)
        self.variant, seen = np.zeros(len(tokens), "i8"), defaultdict(int)
        for i, t in enumerate(tokens):   # ids of equal bytes are told apart
            self.variant[i] = seen[t]
            seen[t] += 1
        self.variants = max(seen.values(), default=1)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        before = np.cumsum(length) - length
        return self.flat[np.repeat(self.begin[ids] - before, length) + np.arange(length.sum())]


class Links:
    """Numbers for all links two vocabularies allow.

    A link whose B token is not longer is numbered by its A token, the B token's
    length and its variant; other links by their B token and the A token's length.
    """

    def __init__(self, a: Spelling, b: Spelling):
        self.a, self.b = a, b
        self.of_a = a.begin * b.variants
        self.of_b = len(a.flat) * b.variants + b.begin * a.variants
        self.count = len(a.flat) * b.variants + len(b.flat) * a.variants

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = self.a.length[a], self.b.length[b]
        return np.where(lb <= la, self.of_a[a] + (lb - 1) * self.b.variants + self.b.variant[b],
                        self.of_b[b] + (la - 1) * self.a.variants + self.a.variant[a])

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The A and B ids of link numbers."""
        found = []
        for own, other, start in ((self.a, self.b, 0), (self.b, self.a, len(self.a.flat) * self.b.variants)):
            ids = defaultdict(list)
            for i, token in enumerate(other.tokens):
                ids[token].append(i)
            mine = numbers[(numbers >= start) & (numbers < start + len(own.flat) * other.variants)] - start
            at = np.searchsorted(own.begin + own.length, mine // other.variants, side="right")
            length = mine // other.variants - own.begin[at] + 1
            match = [ids[own.tokens[t][len(own.tokens[t]) - n:]][v] for t, n, v in
                     zip(at.tolist(), length.tolist(), (mine % other.variants).tolist(), strict=True)]
            found.append((at, np.array(match, "i8")))
        (a1, b1), (b2, a2) = found
        out_a, out_b = np.zeros(len(numbers), "i8"), np.zeros(len(numbers), "i8")
        first = numbers < len(self.a.flat) * self.b.variants
        out_a[first], out_b[first], out_a[~first], out_b[~first] = a1, b1, a2, b2
        return out_a, out_b


@dataclass
class Aligned:
    """Both token lists of several texts, and the places of their common ends.

    ``a_at``, ``b_at`` and ``cuts_at`` say where each text begins (and the last one
    ends) in ``a``, ``b`` and in ``cut_a``, ``cut_b``, the places in ``a`` and ``b``.
    """

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    cuts_at: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray


class Aligner:
    """Two encoders of one worker and what is known of their vocabularies."""

    def __init__(self, vocabulary: str, model: str):
        self.enc_a: ByWord = encoder(vocabulary, plain_specials=True, max_words=WORDS)
        self.enc_b: ByWord = pieces(model, WORDS)
        self.a, self.b = Spelling(self.enc_a.spelling()), Spelling(self.enc_b.spelling())
        self.links = Links(self.a, self.b)

    def align(self, texts: list[str]) -> Aligned:
        """Align ``texts``; those that either tokenizer does not spell exactly have no tokens."""
        lists = []
        raw = [b" " + t.encode() if t else b"" for t in texts]
        want = np.frombuffer(b"".join(raw), "u1")
        want_at = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype="i8")])
        good = np.array([bool(t) for t in texts], bool)
        for enc, spelling, inputs in ((self.enc_a, self.a, [" " + t if t else "" for t in texts]),
                                      (self.enc_b, self.b, texts)):
            ids, at = enc.encode_flat(inputs)
            ids = ids.astype("i8")
            sizes = np.concatenate([[0], np.cumsum(spelling.length[ids])])[at]
            got = spelling.spell(ids)
            if np.array_equal(sizes, want_at):
                wrong = np.flatnonzero(got != want)
                good[np.unique(np.searchsorted(want_at, wrong, side="right") - 1)] = False
            else:
                good &= np.array([got[s:e].tobytes() == r for s, e, r in
                                  zip(sizes.tolist(), sizes[1:].tolist(), raw, strict=False)])
            lists.append((ids, at))
        if not good.all():
            lists = [(ids[np.repeat(good, np.diff(at))], np.concatenate([[0], np.cumsum(np.where(good, np.diff(at), 0))]))
                     for ids, at in lists]
        (a, a_at), (b, b_at) = lists
        # ends in the bytes of all texts together: ascending, and equal at the end of each text
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        a_short = np.diff(a_at) <= np.diff(b_at)
        in_a, in_b = np.repeat(a_short, np.diff(a_at)), np.repeat(~a_short, np.diff(b_at))
        cut_a, cut_b = [], []
        for drives, (short, s_at, mine), (long, l_at), (cut_s, cut_l) in (
                (a_short, (end_a, a_at, in_a), (end_b, b_at), (cut_a, cut_b)),
                (~a_short, (end_b, b_at, in_b), (end_a, a_at), (cut_b, cut_a))):
            if not mine.any():
                continue
            place = np.flatnonzero(mine)
            text = np.repeat(np.flatnonzero(drives), np.diff(s_at)[drives])
            n_short, n_long = np.diff(s_at)[text], np.diff(l_at)[text]
            hit = gallop(short[place], long, l_at[text] + (place - s_at[text]) * n_long // n_short)
            same = long[hit] == short[place]
            cut_s.append(place[same])
            cut_l.append(hit[same])
        cuts = [np.sort(np.concatenate([np.zeros(0, "i8"), *c])) for c in (cut_a, cut_b)]
        return Aligned(a, b, a_at, b_at, *cuts, np.searchsorted(cuts[0], a_at), end_a, end_b)

    def written(self, found: Aligned) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        n = len(found.a) + len(found.b)
        last_a, last_b = np.zeros(len(found.a), bool), np.zeros(len(found.b), bool)
        last_a[found.cut_a] = last_b[found.cut_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.concatenate([[0], found.cut_b + 1])   # B tokens before a group
        at_a = np.arange(len(found.a)) + before_b[group_a]
        at_b = np.arange(len(found.b)) + found.cut_a[group_b] + 1
        width = max(self.a.width, self.b.width)
        cells, digits = np.zeros((n, width), "u1"), np.zeros(n, "i8")
        for spelling, ids, at, last, mark in ((self.a, found.a, at_a, last_a, ord("|")),
                                              (self.b, found.b, at_b, last_b, ord(";"))):
            cells[at, :spelling.width] = spelling.decimal[ids]
            digits[at] = spelling.digits[ids]
            cells[at, spelling.digits[ids]] = np.where(last, mark, ord(","))
        text = cells[np.arange(width) <= digits[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(digits + 1)])[found.a_at + found.b_at].tolist()
        return [text[s:max(s, e - 1)] for s, e in zip(ends, ends[1:], strict=False)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(vocabulary: str | None = None, model: str | None = None) -> Aligner:
    """The aligner of this process; it is built once."""
    key = (vocabulary or default_vocabulary(), model or piece_vocabulary())
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``groups`` of each row of ``docs``: the tokens of both tokenizers between common ends.

    A group holds the A ids, the B ids, the byte range in space+text, and for each A
    token the first and last B token of the group (from 0) whose bytes it shares.
    ``vocabulary`` is a file of the tokenizers library (A), ``model`` one of sentencepiece (B).

    Texts that are null, empty, or not spelled exactly by both have no groups. Null and
    repeated ids stay as they are; rows are told apart by nothing else, so ``row`` numbers
    them inside this result. Columns other than ``doc_id`` and ``text`` are not read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = aligner(vocabulary, model)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for start, stop in slices(texts, characters=CHARACTERS):
                found = own.align(texts[start:stop])
                begin_a = found.end_a - own.a.length[found.a]
                # B tokens that share bytes with an A token: ranks of its begin and end among B's ends
                first = np.searchsorted(found.end_b, begin_a, side="right")
                last = np.searchsorted(found.end_b, found.end_a, side="left")
                rows = []
                for i in range(stop - start):
                    base = found.end_a[found.a_at[i] - 1] if found.a_at[i] else 0
                    pa, pb, groups = found.a_at[i], found.b_at[i], []
                    for c in range(found.cuts_at[i], found.cuts_at[i + 1]):
                        qa, qb = found.cut_a[c] + 1, found.cut_b[c] + 1
                        groups.append({"a": found.a[pa:qa].tolist(), "b": found.b[pb:qb].tolist(),
                                       "start": int(begin_a[pa] - base), "stop": int(found.end_a[qa - 1] - base),
                                       "overlaps": [{"first": int(x - pb), "last": int(y - pb)} for x, y in
                                                    zip(first[pa:qa], last[pa:qa], strict=True)]})
                        pa, pb = qa, qb
                    rows.append(groups)
                yield pd.DataFrame({"row": batch["row"].iloc[start:stop].array,
                                    "doc_id": batch["doc_id"].iloc[start:stop].astype("Int64").array, "groups": rows})

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInPandas(run, GROUPS)


def digests(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Per row of ``docs``, stored: token and group counts, the numbers of its links and the hash of its groups."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = aligner(vocabulary, model)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for start, stop in slices(texts, characters=CHARACTERS):
                found = own.align(texts[start:stop])
                slots = own.links.number(found.a[found.cut_a], found.b[found.cut_b]).astype("<i4").tobytes()
                at, n_a = (4 * found.cuts_at).tolist(), np.diff(found.a_at)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[start:stop].astype("Int64").array, "n_a": n_a,
                    "n_b": np.diff(found.b_at), "n_groups": np.diff(found.cuts_at),
                    "slots": [slots[s:e] for s, e in zip(at, at[1:], strict=False)],
                    "groups_sha256": [sha256(w).hexdigest() if n else "" for w, n in
                                      zip(own.written(found), n_a.tolist(), strict=True)]})

    return stored(docs.select("doc_id", "text").mapInPandas(run, DIGEST), "aligned")


def link_counts(found: DataFrame, allowed: int) -> DataFrame:
    """``slot`` and ``n``: how often each link occurs in all rows of ``digests``; tasks add up first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(allowed, "i8")
        for batch in batches:
            for raw in batch["slots"]:
                np.add.at(total, np.frombuffer(raw, "<i4"), 1)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"slot": seen, "n": total[seen]})

    return found.select("slots").mapInPandas(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def align_counts(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A link joins an A and a B token that end together; its count is how many links of
    all rows join the same ids. ``n_best`` counts links of the highest count for their
    B id. The counts of links, numbered from the vocabularies (some 0.8 million for
    vocabularies of 50,000 and 32,000 ids, however many documents), are brought to the
    driver and shipped: at most 17 bytes a number.

    Texts that are null, empty, or not spelled exactly by both tokenizers have zeros and
    an empty hash. Null and repeated ids give a row each. No rows give none.
    """
    spark: SparkSession = docs.sparkSession
    own = aligner(vocabulary, model)
    found = digests(docs, vocabulary, model)
    table = link_counts(found, own.links.count).toPandas()  # bounded by the vocabularies
    counts, best = np.zeros(own.links.count, "i8"), np.zeros(own.links.count, bool)
    slots, n = table["slot"].to_numpy("i8"), table["n"].to_numpy("i8")
    counts[slots] = n
    _, b = own.links.pairs(slots)
    highest = np.zeros(len(own.b.tokens), "i8")
    np.maximum.at(highest, b, n)
    best[slots] = n == highest[b]
    shipped = spark.sparkContext.broadcast((counts, best))

    @F.pandas_udf("struct<n_links: bigint, n_best: bigint, count_sum: bigint>")
    def sums(slots: pd.Series) -> pd.DataFrame:
        count, top = shipped.value
        rows = [np.frombuffer(raw, "<i4") for raw in slots]
        return pd.DataFrame({"n_links": [len(r) for r in rows], "n_best": [int(top[r].sum()) for r in rows],
                             "count_sum": [int(count[r].sum()) for r in rows]})

    return found.withColumn("sums", sums("slots")).select(
        "doc_id", "n_a", "n_b", "n_groups", "sums.n_links", "sums.n_best", "sums.count_sum", "groups_sha256")


def link_table(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """``a_id``, ``b_id`` and ``n`` of all links of ``docs``, decoded from their numbers in tasks."""
    own = aligner(vocabulary, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = aligner(vocabulary, model).links.pairs(batch["slot"].to_numpy("i8"))
            yield pd.DataFrame({"a_id": a, "b_id": b, "n": batch["n"]})

    return link_counts(digests(docs, vocabulary, model), own.links.count).mapInPandas(run, "a_id int, b_id int, n bigint")
