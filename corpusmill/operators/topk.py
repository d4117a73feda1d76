"""Best k rows per group, reduced in two steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank", salt_on: str | None = None, salts: int = 64) -> DataFrame:
    """Keep the ``k`` first rows of each group and number them from 1.

    Catalyst already cuts every input partition to k rows per group. With
    ``salt_on`` the survivors of all partitions meet in ``salts`` tasks per group
    before they meet in one, so the last task sees at most ``salts * k`` rows.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    if salt_on is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (salted.withColumn("_first", F.row_number().over(first))
              .filter(F.col("_first") <= k).drop("_first", "_salt"))
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)
