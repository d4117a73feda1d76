"""Substring joins without comparing every block with every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Windows of PIECE characters are hashed; of each SPAN consecutive ones the smallest hash is kept.
PIECE, SPAN = 12, 8
KEPT_FROM = PIECE + SPAN - 1
# Hashes a worker holds before it hands them on, besides those of one text.
OUT_ROWS = 100_000


def _kept_hashes(text: str) -> np.ndarray:
    """The smallest hash of each run of windows: what a text shares with every block of KEPT_FROM characters in it."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8")
    if len(codes) < KEPT_FROM:
        return np.zeros(0, "i8")
    hashes = np.zeros(len(codes) - PIECE + 1, "u8")
    for i in range(PIECE):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + len(hashes)]
    hashes ^= hashes >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, SPAN).min(axis=1)).view("i8")


def _kept(rows: DataFrame, name: str, text: str) -> DataFrame:
    """A row (``name``, ``_h``) for each kept hash of each text.

    Hashes leave as numbers in rows, a bounded number at a time, so a worker holds no
    more than one batch of texts, whatever the table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            at, found, held = [], [], 0
            for i in range(len(texts)):
                hashes = _kept_hashes(texts[i].as_py())
                at.append(np.full(len(hashes), i, "i8"))
                found.append(hashes)
                held += len(hashes)
                if held >= OUT_ROWS or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(found))], [name, "_h"])
                    at, found, held = [], [], 0

    kind = rows.schema[name].dataType.simpleString()
    return rows.select(name, text).mapInArrow(run, f"`{name}` {kind}, _h bigint")


def contained_in(blocks: DataFrame, texts: DataFrame, block_id: str, text_id: str) -> DataFrame:
    """Pairs (block, text) where the text holds the block word for word. Both have a ``text`` column.

    A long block is looked up by the rarest of its kept hashes, so common phrases make
    no hot key; short ones are matched against the substrings of their lengths.
    Empty and null blocks match nothing. Ids may repeat with other texts.
    """
    size = F.length("_block")
    found = blocks.filter(F.length("text") > 0).select(block_id, F.col("text").alias("_block"))
    found = found.distinct().withColumn("_key", F.xxhash64("_block"))
    bodies = texts.filter(F.length("text") > 0).select(text_id, "text")
    asked = _kept(found.filter(size >= KEPT_FROM).select("_key", "_block").distinct(), "_key", "_block")
    windows = _kept(bodies, text_id, "text")
    usable = windows.join(asked.select("_h").distinct(), "_h", "left_semi")
    spread = usable.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    # a hash no text has rules its block out, and is the cheapest of all
    rated = asked.join(spread, "_h", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = rated.groupBy("_key").agg(F.min_by("_h", F.struct("_n", "_h")).alias("_h"))
    pairs = rarest.join(usable, "_h").select("_key", text_id).join(found, "_key").join(bodies, text_id)
    matched = pairs.filter(F.contains("text", F.col("_block"))).select(block_id, text_id)
    short = found.filter(size < KEPT_FROM)
    for row in sorted(short.select(size.alias("n")).distinct().collect()):  # KEPT_FROM lengths at most
        parts = bodies.select(text_id, F.explode(F.array_distinct(F.regexp_extract_all(
            "text", F.lit(r"(?s)(?=(.{%d}))" % row["n"]), F.lit(1)))).alias("_block"))
        matched = matched.unionByName(short.filter(size == row["n"]).join(parts, "_block").select(block_id, text_id))
    return matched.distinct()


def mark_subtags(tags: DataFrame) -> DataFrame:
    """For each distinct ``tag``, whether it is part of a longer one. Empty and null tags are part of none.

    Of the tags only the pieces of lengths that other tags have are looked up, as hashes; what
    meets is verified on the texts, once a tag.
    """
    sized = tags.select("tag", F.length("tag").alias("n"))
    lengths = sorted(r["n"] for r in sized.where("n > 0").select("n").distinct().collect())  # no more than the longest tag has letters
    if not lengths:
        return tags.withColumn("is_sub", F.lit(False))
    pieces = F.flatten(F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda size: size < F.col("n")), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("n") - size + 1), lambda at: F.struct(F.xxhash64(F.substr("tag", at, size)).alias("hash"), at.alias("at"), size.alias("size")))))
    known = sized.where("n > 0").select(F.xxhash64("tag").alias("hash"), F.col("n").alias("size"), F.col("tag").alias("inner"))
    met = sized.select("tag", F.explode(F.array_distinct(pieces)).alias("p")).select("tag", "p.hash", "p.at", "p.size").join(known, ["hash", "size"])
    inner = met.where(F.substr("tag", F.col("at"), F.col("size")) == F.col("inner")).select(F.col("inner").alias("tag")).distinct()
    marked = inner.withColumn("is_sub", F.lit(True))
    return tags.join(marked, "tag", "left").withColumn("is_sub", F.coalesce("is_sub", F.lit(False)))
