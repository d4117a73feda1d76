"""Packing: concatenate the token ids of all documents and cut the stream into windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.bpe import default_vocabulary, encoder, slices
from corpusmill.llm.stores import prepare, stored

ENCODED = "part int, doc_id bigint, before bigint, n bigint, ids binary"
PIECES = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, sequence_tokens bigint")
ROWS = 256


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(part, doc_id, tokens of the part before it, n, ids), stored; two bytes an id, or four.

    ``part`` is the task that encoded the document and ``before`` a running sum
    inside that task, so no document has to be moved to be placed in the stream.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for start, stop in slices(texts):
                some = batch.iloc[start:stop]
                ids = [x + end for x in enc.encode(texts[start:stop])]
                n = np.array([len(x) for x in ids], "i8") // enc.dtype.itemsize
                yield pd.DataFrame({"part": part, "doc_id": some["doc_id"].astype("Int64").array,
                                    "before": before + np.cumsum(n) - n, "n": n, "ids": ids})
                before += int(n.sum())

    return stored(docs.select("doc_id", "text").mapInPandas(run, ENCODED), "encoded")


def _cut(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = []
                for doc, first, n, ids, total in batch.iloc[at:at + ROWS][
                        ["doc_id", "first", "n", "ids", "total"]].itertuples(index=False):
                    wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                    start = 0
                    while start < n:  # one piece for each window that the document touches
                        sequence, offset = divmod(int(first) + start, window)
                        length = min(window - offset, n - start)
                        rows.append((doc, start, length, wide[4 * start:4 * (start + length)], n, sequence,
                                     offset, min(window, int(total) - sequence * window)))
                        start += length
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return run


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1,
         vocabulary: str | None = None) -> DataFrame:
    """Cut the concatenated documents into sequences of ``window`` tokens.

    Two passes: the first encodes each document where it lies and stores its ids
    with a running sum inside the task; the sums of the tasks (one row each) are
    accumulated to global offsets; the second pass cuts each document at the
    windows it touches. Every sequence is full but the last of all, whose tokens
    are in ``sequence_tokens``; so padding is below one window in all.

    One row per piece (the boundary records): ``doc_id``, ``start`` (ids of the
    document before the piece), ``length``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` in the
    sequence, ``sequence_tokens``.

    A null or empty text is its end id alone. A null ``doc_id`` stays null, and
    repeated ids are packed as documents of their own. No documents give no rows.
    Columns other than ``doc_id`` and ``text`` are not read.
    """
    prepare(docs.sparkSession)
    encoded = encode_documents(docs, vocabulary or default_vocabulary(), end_id)
    # one row per task of the first pass
    parts = encoded.groupBy("part").agg(F.sum("n").alias("tokens"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"),
                         F.sum("tokens").over(Window.partitionBy()).alias("total"))
    # one row of 20 bytes per task of the first pass: 2 MB for 100,000 tasks
    placed = encoded.join(F.broadcast(bases), "part").select(
        "doc_id", "n", "ids", "total", (F.col("base") + F.col("before")).alias("first"))
    return placed.mapInPandas(_cut(window), PIECES)
