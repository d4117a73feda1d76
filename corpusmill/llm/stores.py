"""Where the operators of this subpackage keep what they must not compute twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.scratch import scratch_folder
from corpusmill.shipping import ship


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as compressed Parquet to the shared folder and read it back.

    The folder lies below ``spark.checkpoint.dir``; what follows no longer
    depends on the executors that computed ``df``.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Make this package importable in the tasks of ``spark``."""
    ship(spark)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start with ``names`` and clash with none of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out
