"""The vector store: a parquet table of chunks with their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.vectors import binarise, l2_normalise

BACKENDS = ("flat", "compressed", "binary")


def build(chunks: DataFrame, backend: str = "flat") -> DataFrame:
    """Rows ready to be stored: unit vectors in double precision, or packed sign bits (binary)."""
    if backend not in BACKENDS:
        raise ValueError(f"backend is one of {BACKENDS}, got {backend!r}")
    if backend == "binary":
        return chunks.withColumn("bits", binarise(F.col("embedding"))).drop("embedding")
    return chunks.withColumn("embedding", l2_normalise(F.col("embedding")))


def save(store: DataFrame, folder: str, mode: str = "errorifexists", backend: str = "flat") -> None:
    """``compressed`` takes more time to write for smaller files, and gives the same vectors back."""
    out = store.write.mode(mode).option("compression", "zstd")
    if backend == "compressed":
        out = out.option("parquet.compression.codec.zstd.level", "15")
    out.parquet(folder)


def save_bucketed(store: DataFrame, table: str, buckets: int, id_col: str = "chunk_id") -> None:
    """As a table bucketed by id, so that vectors, text and votes of a chunk join without an exchange."""
    store.write.bucketBy(buckets, id_col).sortBy(id_col).option("compression", "zstd").saveAsTable(table)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def append(store: DataFrame, extra: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Both tables, or an error if an id of ``extra`` is taken or repeated."""
    taken = extra.select(id_col).join(store.select(id_col), id_col, "left_semi")
    repeated = extra.groupBy(id_col).count().filter("count > 1").select(id_col)
    if not taken.unionByName(repeated).isEmpty():
        raise ValueError("some ids are already in use")
    return store.unionByName(extra)


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)


def delete(store: DataFrame, ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return store.join(ids.select(id_col), id_col, "left_anti")


def check_embeddings(vectors: DataFrame) -> None:
    """Same length everywhere, not all alike, none all zero; one row comes back."""
    row = vectors.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"),
                      F.count_if(~F.exists("embedding", lambda x: x != 0)).alias("zeros"),
                      F.min(F.xxhash64("embedding")).alias("a"), F.max(F.xxhash64("embedding")).alias("b")).first()
    if row["lo"] != row["hi"]:
        raise ValueError("the vectors differ in length")
    if row["zeros"]:
        raise ValueError("some vectors are all zero")
    if row["a"] == row["b"]:
        raise ValueError("all vectors are the same")


def check_binary_options(normalise: bool = False, distance: str = "hamming") -> None:
    if normalise:
        raise ValueError("binary vectors cannot be L2-normalised")
    if distance != "hamming":
        raise ValueError("the binary store only knows the Hamming distance")
