"""What the vector operators share: usable rows, and blocks of vectors in one binary value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector with components, all finite and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0),
                      F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return np.stack([np.asarray(v, "f8") for v in column]) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chunked(df: DataFrame, keys: list[str], by: Column, rows: int) -> DataFrame:
    """``df`` with ``chunk``: a key's rows dealt by the hash ``by`` into parts of about ``rows``."""
    counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = df.alias("l").join(counts.alias("r"), same)
    return joined.select("l.*", F.pmod(by, F.col("r._parts")).cast("int").alias("chunk"))
