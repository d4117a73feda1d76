"""Bounded samples and stable folds of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARKS = 1 << 16


def fold_of(key: str | Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; null for a null id."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % folds


def bounded_sample(df: DataFrame, columns: list[str], rows: int, seed: int) -> DataFrame:
    """``rows`` rows of ``df`` (all, if it has no more), chosen by a hash of ``columns``.

    Rows of the lowest of 65,536 marks are taken until the bound, and of the mark in which
    it falls as many as are left. A mark that holds more than a 64th of all rows, as a row
    repeated very often does, gives its share. So the bound is exact, however often an id or
    a whole row is repeated; a rerun takes the same rows but for those of a mark that is
    taken in part. Only the counts of the marks come to the driver.
    """
    mark = F.pmod(F.xxhash64(*(F.col(c) for c in columns), F.lit(seed)), F.lit(_MARKS))
    counts = {r["mark"]: r["count"] for r in df.groupBy(mark.alias("mark")).count().collect()}
    total = sum(counts.values())
    if total <= rows:
        return df
    parts = {m: n * rows // total for m, n in counts.items() if n > total / 64}
    left, whole = rows - sum(parts.values()), -1
    for m in sorted(counts.keys() - parts.keys()):
        if counts[m] > left:
            parts[m], left = left, 0
            break
        left, whole = left - counts[m], m
    for m in parts:  # what rounding left over
        more = min(left, counts[m] - parts[m])
        parts[m], left = parts[m] + more, left - more
    out = df.where((mark <= whole) & ~mark.isin([m for m in parts if m <= whole]))
    for m, n in parts.items():
        out = out.unionByName(df.where(mark == m).limit(n))
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int = 5, held_out: int = 0,
                  most_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """(doc_id, text, ``label``) of at most ``most_rows`` labelled documents outside the held-out fold.

    Labels are 0 or 1; others, and null ids or labels, are not used. Of repeated labels
    of an id the largest counts; documents that repeat an id are rows of their own. The
    ids and labels of at most ``most_rows`` ids are shipped to the documents: 12 bytes each.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .where(fold_of("doc_id", folds) != held_out)
             .groupBy("doc_id").agg(F.max(label).cast("int").alias(label)))
    known = bounded_sample(known, ["doc_id"], most_rows, seed)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return bounded_sample(found, ["doc_id", "text"], most_rows, seed)
