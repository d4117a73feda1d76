"""Guards for anything that leaves the cluster's partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than it needs."""
    return df.limit(max_rows + 1).count() <= max_rows


def take_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Bring a small result to the driver, or refuse."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} holds more than {max_rows} rows; keep it distributed")
    return rows
