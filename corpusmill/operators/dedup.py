"""Copies and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_hashes(docs: DataFrame, key: str = "content_hash") -> DataFrame:
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("n_copies")).filter(F.col("n_copies") > 1)


def merge_copies(docs: DataFrame, order: str, key: str = "content_hash", tag: str = "source_tag",
                 metadata: str | None = None) -> DataFrame:
    """One row per content: columns of the first copy, every tag once, in order of first use.

    Copies are folded per (content, tag) before they meet, so a content with any
    number of copies brings at most one row per tag to its final task. Metadata
    keys are folded the same way: the first copy that has a key gives its value.
    """
    per_tag = docs.groupBy(key, tag).agg(F.min(order).alias("_at"), F.count(F.lit(1)).alias("_n"))
    tags = F.transform(F.array_sort(F.collect_list(F.struct("_at", tag))), lambda s: s[tag])
    merged = per_tag.groupBy(key).agg(F.min("_at").alias(order), F.sum("_n").alias("n_copies"),
                                      F.array_join(tags, " ").alias("_tags"))
    rest = [c for c in docs.columns if c not in (key, tag, order, metadata)]
    if rest:
        # a column at a time, all from one row; what the caller leaves out, a text above all, is not moved
        firsts = docs.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in rest))
        merged = merged.join(firsts, key).select(key, order, "n_copies", "_tags", *rest)
    if metadata is not None:
        entries = docs.select(key, order, F.explode(metadata).alias("_k", "_v"))
        per_key = entries.groupBy(key, "_k").agg(F.min_by("_v", order).alias("_v"))
        maps = per_key.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(metadata))
        merged = merged.join(maps, key, "left")
    return merged.withColumnRenamed("_tags", tag)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the lowest ``order`` per key, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


# Caches: parquet tables of key -> value. A lookup reads the hits, an anti-join finds the misses.

def reply_key(prompt: Column, model: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(prompt.alias("prompt"), model.alias("model"))), 256), 1, 20)


def cache_hits(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache, key)


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def cache_alive(cache: DataFrame, written: str, now: Column, days: int) -> DataFrame:
    """Entries younger than ``days``; zero or less keeps everything."""
    if days <= 0:
        return cache
    return cache.filter(F.col(written) > now - F.make_dt_interval(F.lit(days)))


def cached(wanted: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """Stored values where there are some, computed ones elsewhere; each key is computed once."""
    missing = cache_misses(wanted, cache, key).dropDuplicates([key])
    known = cache.unionByName(compute(missing).select(*cache.columns))
    return wanted.join(known, key)
