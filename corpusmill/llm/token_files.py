"""Token ids as flat files: unsigned integers, 64-bit offsets, read through a memory map.

A folder holds one shard per range of document ids, in that order:

* ``NAME.ids``      the ids of the shard's documents, one after another, little-endian;
* ``NAME.docs``     its document ids, 8 bytes each, then a byte each that is 1 for a null;
* ``NAME.offsets``  one 64-bit integer more than it has documents: how many ids of
  the whole folder lie before each document, and before the next shard;
* ``manifest``      a Parquet table: shard, documents, ids, width, ids before it, its file of offsets.

Each task writes its ids and the lengths of its documents; the bases of the shards
are prefix sums over their rows, and a second pass over the lengths writes the
offsets. A task's files have names of their own, which its row tells; so of several
attempts at a task only the files of the one that counts are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.bpe import default_vocabulary, encoder, slices
from corpusmill.llm.stores import prepare
from corpusmill.operators.scratch import scratch_folder

SHARD = "part int, name string, documents bigint, ids bigint, dtype string"
MANIFEST = f"{SHARD}, base bigint, offsets string"
ROWS = 256
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


class _Files:
    """The files of one attempt at a task."""

    def __init__(self, folder: str, name: str, kinds: tuple[str, ...]):
        store, base = _opened(folder)
        store.create_dir(base, recursive=True)
        self.out = {k: store.open_output_stream(f"{base}/{name}.{k}") for k in kinds}

    def done(self) -> None:
        for stream in self.out.values():
            stream.close()


def _read(folder: str, name: str, kind: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped where the store is a local path, else read."""
    store, base = _opened(folder)
    path = f"{base}/{name}.{kind}"
    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), dtype)


def write_token_files(docs: DataFrame, folder: str | None = None, end_id: int = 2,
                      vocabulary: str | None = None, dtype: str | None = None) -> str:
    """Encode ``docs`` and write their ids in ascending order of ``doc_id``; return the folder.

    ``dtype`` is by default ``<u2`` for vocabularies of up to 65,536 ids, else ``<u4``.
    Null ids come first; rows of the same id are ordered by a hash of their text. A null or
    empty text is its end id alone. No documents give a folder without shards.
    Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or scratch_folder(spark, "tokens")
    vocabulary = vocabulary or default_vocabulary()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(vocabulary, dtype), TaskContext.get().partitionId()
        end, name = np.array([end_id], enc.dtype).tobytes(), f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        files, docs_seen, nulls, lengths = None, [], [], []
        for batch in batches:
            texts = batch["text"].tolist()
            for start, stop in slices(texts):
                files = files or _Files(folder, name, ("ids", "lengths", "docs"))
                some = batch.iloc[start:stop]
                ids = [x + end for x in enc.encode(texts[start:stop])]
                files.out["ids"].write(b"".join(ids))
                lengths.append(np.array([len(x) for x in ids], "<i8") // enc.dtype.itemsize)
                nulls.append(some["doc_id"].isna().to_numpy())
                docs_seen.append(some["doc_id"].fillna(0).to_numpy("<i8"))
        if files is None:
            return
        counts = np.concatenate(lengths)
        files.out["lengths"].write(counts.tobytes())
        files.out["docs"].write(np.concatenate(docs_seen).tobytes() + np.concatenate(nulls).tobytes())
        files.done()
        yield pd.DataFrame([(part, name, len(counts), int(counts.sum()), enc.dtype.str)],
                           columns=["part", "name", "documents", "ids", "dtype"])

    # rows equal in id and text are told apart by where they lie, so that ranges can part them too
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ordered = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                           F.monotonically_increasing_id().alias("row"))
               .repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text"))
    shards = f"{folder}/shards"
    ordered.mapInPandas(write, SHARD).write.mode("overwrite").parquet(shards)
    written = spark.read.schema(SHARD).parquet(shards)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    based = written.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = []
            for name, base in batch[["name", "base"]].itertuples(index=False):
                lengths = _read(folder, name, "lengths", "<i8")
                names.append(f"{name}-{uuid.uuid4().hex[:12]}")
                files = _Files(folder, names[-1], ("offsets",))
                files.out["offsets"].write((base + np.concatenate([[0], np.cumsum(lengths)])).astype("<i8").tobytes())
                files.done()
            yield batch.assign(offsets=names)

    (_one_a_task(based, written.count()).mapInPandas(offsets, MANIFEST)
     .write.mode("overwrite").parquet(f"{folder}/manifest"))
    return folder


def _one_a_task(manifest: DataFrame, shards: int) -> DataFrame:
    """The rows of a manifest in as many partitions; given a number, adaptive execution merges none."""
    return manifest.repartitionByRange(max(shards, 1), "part")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a folder: ``doc_id``, ``start`` (ids of the folder before it),
    ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit), shard by shard."""
    prepare(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, n, base, dtype, places in batch[["name", "documents", "base", "dtype", "offsets"]].itertuples(index=False):
                raw = _read(folder, name, "docs", "u1")
                docs, null = raw[:8 * n].view("<i8"), raw[8 * n:].astype(bool)
                offsets, ids = _read(folder, places, "offsets", "<i8"), _read(folder, name, "ids", dtype)
                for at in range(0, n, ROWS):
                    to = min(n, at + ROWS)
                    cuts = offsets[at:to + 1]
                    yield pd.DataFrame({
                        "doc_id": pd.array(docs[at:to], "Int64").copy() if not null[at:to].any()
                        else pd.Series(docs[at:to]).astype("Int64").mask(pd.Series(null[at:to])),
                        "start": cuts[:-1], "n_tokens": np.diff(cuts),
                        "ids": [ids[a:b].astype("<u4").tobytes() for a, b in
                                zip((cuts[:-1] - base).tolist(), (cuts[1:] - base).tolist(), strict=True)]})

    manifest = read_manifest(spark, folder)
    return _one_a_task(manifest, manifest.count()).mapInPandas(read, DOCUMENTS)
