"""Sequence operators that survive one key holding a large share of the rows.

A plain window over the key sorts the whole key in one task. Here the order is
cut into buckets first: the totals of the buckets (one row each, pre-aggregated
on the map side) are accumulated over the key, and the rows are only ever sorted
inside ``(key, bucket)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                   values: dict[str, Column], include_self: bool = True) -> DataFrame:
    """Add the running sums of ``values`` (by name) over ``order`` within ``keys``.

    ``bucket`` must not decrease along ``order``, so that whole buckets follow
    each other; it should hold a bounded number of rows.
    """
    data = df.withColumns({"_bucket": bucket, **{f"_value_{name}": value for name, value in values.items()}})
    groups = [*keys, "_bucket"]
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = data.groupBy(*groups).agg(*(F.sum(f"_value_{name}").alias(f"_total_{name}") for name in values))
    before = totals.select(*groups, *(F.sum(f"_total_{name}").over(earlier).alias(f"_before_{name}") for name in values))
    last = Window.currentRow if include_self else -1
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    zero = F.lit(0)
    summed = data.join(before, groups).withColumns({
        name: F.coalesce(F.col(f"_before_{name}"), zero) + F.coalesce(F.sum(f"_value_{name}").over(inside), zero)
        for name in values})
    return summed.drop("_bucket", *(f"_{part}_{name}" for name in values for part in ("value", "before")))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                  value: Column, name: str, include_self: bool = True) -> DataFrame:
    """Add the running sum of one ``value``; see :func:`running_totals`."""
    return running_totals(df, keys, order, bucket, {name: value}, include_self)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                name: str) -> DataFrame:
    """Add the 1-based position of each row within ``keys``."""
    numbered = running_total(df, keys, order, bucket, F.lit(1).cast("bigint"), name)
    return numbered.withColumn(name, F.col(name).cast("bigint"))


def with_previous(df: DataFrame, keys: Sequence[str], position: str, column: str,
                  name: str, step: int = 1) -> DataFrame:
    """Add ``column`` of the row ``step`` positions before, matched by position.

    The join key holds one row, so no key can be hot.
    """
    earlier = df.select(*keys, (F.col(position) + step).alias(position),
                        F.col(column).alias(name))
    return df.join(earlier, [*keys, position], "left")
