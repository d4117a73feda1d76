"""Vector arithmetic on arrays, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: components above it count as a set bit.
BIT_THRESHOLD = 1e-10


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalise(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(
        v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def score_from_squared_l2(distance: Column) -> Column:
    """Relevance of a squared distance between unit vectors: the cosine less one half."""
    return 1 - (1 + distance) / 2


def binarise(v: Column) -> Column:
    """Sign bits packed 64 to a BIGINT, the first component in the highest bit; padded with zeros."""
    words = F.sequence(F.lit(0), ((F.size(v) - 1) / 64).cast("int"))

    def word(w: Column) -> Column:
        part = F.slice(v, w * 64 + 1, F.lit(64))
        bits = F.transform(part, lambda x, i: F.when(
            x > BIT_THRESHOLD, F.call_function(
                "shiftleft", F.lit(1).cast("bigint"), (63 - i).cast("int"))).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return F.transform(words, word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def hamming_score(distance: Column, n_bits: Column) -> Column:
    return 1 - F.least(distance / n_bits, F.lit(1.0))
