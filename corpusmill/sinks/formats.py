"""Parsed documents in the formats they are handed out in.

Each chunk becomes one piece; pieces joined by newlines in order are the result.
Pieces stay rows, so a document of any length can be written without being
gathered first.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip

FORMATS = ("text", "split_text", "xml", "dict")


def pieces(chunks: DataFrame, fmt: str = "text") -> DataFrame:
    """``chunks``: any key columns, pos (from 1), n_chunks, page_content and, for dict, metadata."""
    body, pos, n = F.col("page_content"), F.col("pos"), F.col("n_chunks")
    if fmt == "text":
        piece = strip(body)
    elif fmt == "split_text":
        numbered = F.concat(F.lit("Doc #"), pos.cast("string"), F.lit("/"), n.cast("string"), F.lit("\n"), body)
        many = F.when(pos == n, F.regexp_replace(numbered, r"\s+\z", "")).otherwise(F.concat(numbered, F.lit("\n\n")))
        many = F.when(pos == 1, F.concat(F.lit("Parsed documents:\n"), many)).otherwise(many)
        piece = F.when(n == 1, F.concat(F.lit("Parsed document:\n"), strip(body))).otherwise(many)
    elif fmt == "xml":
        piece = F.concat(F.lit("<doc id="), (pos - 1).cast("string"), F.lit(">\n"), body, F.lit("\n</doc>"))
        piece = F.when(pos == 1, F.concat(F.lit("<documents>\n"), piece)).otherwise(piece)
        piece = F.when(pos == n, F.concat(piece, F.lit("\n</documents>"))).otherwise(piece)
    elif fmt == "dict":
        piece = F.to_json(F.struct("page_content", "metadata"))
    else:
        raise ValueError(f"format is one of {FORMATS}, got {fmt!r}")
    return chunks.withColumn("piece", piece).drop("page_content", "metadata", "n_chunks")


def write_pieces(rows: DataFrame, folder: str, keys: list[str], mode: str = "append") -> None:
    """Text files with the pieces in order; ranges of the order are written in parallel."""
    rows.repartitionByRange(*keys, "pos").sortWithinPartitions(*keys, "pos").select("piece").write.mode(mode).text(folder)


def in_order(rows: DataFrame, keys: list[str]) -> Iterator[str]:
    """The pieces in order, partition by partition: the driver holds one at a time."""
    for row in rows.select(*keys, "pos", "piece").orderBy(*keys, "pos").select("piece").toLocalIterator():
        yield row["piece"]


def render(rows: DataFrame, keys: list[str]) -> str:
    """The whole result as one string, for a caller that wants to show it."""
    return "\n".join(in_order(rows, keys))


def append_lines(path: str, lines: Iterator[str]) -> int:
    """Append texts to a text file on the driver as they come, and return their number; other files are refused."""
    n = 0
    for n, text in enumerate(lines, 1):
        append_text(path, text)
    return n


def append_text(path: str, text: str) -> None:
    """Append to a text file on the driver; a file that is not text is refused."""
    target = Path(path)
    if target.exists():
        head = target.read_bytes()[:4096]
        if b"\0" in head:
            raise ValueError(f"{path} is not a text file")
    with target.open("a", encoding="utf-8") as out:
        out.write(text + "\n")
