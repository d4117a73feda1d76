"""Arithmetic on numbers, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_scaled(value: Column, digits: int) -> Column:
    """``value`` as a double, scaled in binary and rounded to the nearest whole, halves away from zero.

    Spark rounds the shortest decimal form instead. The two differ where that form ends in a half.
    """
    scaled = value.cast("double") * 10.0 ** digits
    whole = F.rint(scaled)
    rest = scaled - whole
    whole = F.when((scaled > 0) & (rest == 0.5), whole + 1).when((scaled < 0) & (rest == -0.5), whole - 1).otherwise(whole)
    return whole / 10.0 ** digits
