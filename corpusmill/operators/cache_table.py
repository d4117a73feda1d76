"""A key/value table on shared storage: written in runs, deleted by marks, compacted by key.

Each write adds a run: a folder of rows (key, value, written, deleted) that counts once its
job is committed. A read takes of each key what was written last. Compaction writes the
living keys of a base and its runs as a new base, sorted by key, and names the runs
it holds; readers skip those, so a run that is written meanwhile is not lost.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "key string, value {value}, written timestamp, deleted boolean, version bigint"


class CacheTable:
    """Values of type ``value`` by string key, below ``folder``.

    Entries older than ``days`` are gone (0: they stay). Null keys are refused by no one
    and found by no one: they are left out of writes and reads. Of a key repeated within
    a write the largest value is kept.
    """

    def __init__(self, spark: SparkSession, folder: str, value: str = "string", days: int = 0):
        self.spark, self.folder, self.days = spark, folder.rstrip("/"), days
        self.schema = ROW.format(value=value)
        self._last = 0

    def _listed(self, kind: str) -> list[str]:
        """Names of the committed folders of a kind, oldest first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        files = path.getFileSystem(conf)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(n for n in names if not n.endswith("-runs") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def _state(self) -> tuple[list[str], list[str]]:
        """Paths of the newest base (none, or one) and of the runs it does not hold."""
        bases, runs = self._listed("base"), self._listed("runs")
        if not bases:
            return [], [f"{self.folder}/runs/{r}" for r in runs]
        base = f"{self.folder}/base/{bases[-1]}"
        held = {r["run"] for r in self.spark.read.schema("run string").parquet(f"{base}-runs").collect()}
        return [base], [f"{self.folder}/runs/{r}" for r in runs if r not in held]

    def _version(self) -> int:
        self._last = max(self._last + 1, time.time_ns() // 1000)
        return self._last

    def _write(self, rows: DataFrame) -> None:
        version = self._version()
        path = f"{self.folder}/runs/{version:020d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("version", F.lit(version)).select(*(c.split()[0] for c in self.schema.split(", "))).write.parquet(path)

    def _all(self) -> DataFrame:
        base, runs = self._state()
        read = self.spark.read.schema(self.schema)
        return read.parquet(*base, *runs) if base or runs else self.spark.createDataFrame([], self.schema)

    def _living(self, rows: DataFrame, now: Column | None) -> DataFrame:
        """The last write of each key, without deleted and expired ones; map sides keep one row a key."""
        last = rows.groupBy("key").agg(F.max_by(F.struct("value", "written", "deleted"), "version").alias("last"))
        living = last.select("key", "last.*").where(~F.col("deleted"))
        if self.days > 0:
            now = F.current_timestamp() if now is None else now
            living = living.where(F.col("written") > now - F.make_dt_interval(F.lit(self.days)))
        return living

    def mset(self, rows: DataFrame, key: str = "key", value: str = "value", now: Column | None = None) -> None:
        """Write ``rows``; a later write of a key hides earlier ones."""
        folded = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.max(value).alias("value"))
        self._write(folded.withColumns({"written": F.current_timestamp() if now is None else now, "deleted": F.lit(False)}))

    def mdelete(self, keys: DataFrame, key: str = "key", now: Column | None = None) -> None:
        """Mark keys as deleted; unknown ones are no matter."""
        kind = self.schema.split(", ")[1].split(" ", 1)[1]
        marks = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct()
        self._write(marks.withColumns({"value": F.lit(None).cast(kind), "written": F.current_timestamp() if now is None else now,
                                       "deleted": F.lit(True)}))

    def mget(self, keys: DataFrame, key: str = "key", now: Column | None = None) -> DataFrame:
        """``keys`` with their ``value``, only those that are there. The table's rows are first cut to the keys asked for."""
        asked = keys.select(F.col(key).cast("string").alias("key")).distinct()
        found = self._living(self._all().join(asked, "key", "left_semi"), now).select(
            F.col("key").alias("_found"), F.col("value"))
        return keys.join(found, F.col(key).cast("string") == F.col("_found")).drop("_found")

    def missing(self, keys: DataFrame, key: str = "key", now: Column | None = None) -> DataFrame:
        """The rows of ``keys`` that have no value."""
        asked = keys.select(F.col(key).cast("string").alias("key")).distinct()
        found = self._living(self._all().join(asked, "key", "left_semi"), now).select(F.col("key").alias("_found"))
        return keys.join(found, F.col(key).cast("string") == F.col("_found"), "left_anti")

    def keys(self, prefix: str = "", now: Column | None = None) -> DataFrame:
        """The living keys that start with ``prefix``."""
        rows = self._all()
        return self._living(rows.where(F.startswith("key", F.lit(prefix))) if prefix else rows, now).select("key")

    def items(self, now: Column | None = None) -> DataFrame:
        """All living keys with their values."""
        return self._living(self._all(), now).select("key", "value")

    def compact(self, now: Column | None = None) -> None:
        """Write what is living as a new base in ranges of keys, so that a few keys touch a few files."""
        base, runs = self._state()
        if not runs:
            return
        rows = self.spark.read.schema(self.schema).parquet(*base, *runs)
        last = rows.groupBy("key").agg(F.max_by(F.struct("value", "written", "deleted"), "version").alias("last"), F.max("version").alias("version"))
        living = last.select("key", "last.*", "version").where(~F.col("deleted"))
        if self.days > 0:
            now = F.current_timestamp() if now is None else now
            living = living.where(F.col("written") > now - F.make_dt_interval(F.lit(self.days)))
        name = f"{self._version():020d}"
        held = self._listed("base")
        before = [] if not held else [r["run"] for r in self.spark.read.schema("run string").parquet(
            f"{self.folder}/base/{held[-1]}-runs").collect()]
        names = [(r,) for r in [*before, *(p.rsplit("/", 1)[1] for p in runs)]]
        # the list of runs first: a base without one is never seen
        self.spark.createDataFrame(names, "run string").coalesce(1).write.parquet(f"{self.folder}/base/{name}-runs")
        (living.select(*(c.split()[0] for c in self.schema.split(", "))).repartitionByRange("key").sortWithinPartitions("key")
         .write.parquet(f"{self.folder}/base/{name}"))


def through(table: CacheTable, wanted: DataFrame, key: str, compute, now: Column | None = None) -> tuple[DataFrame, int]:
    """``wanted`` with ``value`` from the table, and how many values were computed.

    ``compute`` gets the rows whose key the table lacks, one a key, and returns them with
    ``value``. What it gives is written before it is read, so it is asked once.
    """
    from corpusmill.operators.lineage import checkpointed

    lacking = checkpointed(table.missing(wanted, key, now).dropDuplicates([key]))
    calls = lacking.count()
    if calls:
        table.mset(compute(lacking), key, "value", now)
    return table.mget(wanted, key, now), calls
