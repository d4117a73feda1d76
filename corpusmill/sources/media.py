"""Video, audio and web fetches: the choices around the calls, with the calls left to the caller."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import markdown_images_to_name, markdown_links_to_text, reader_body
from corpusmill.functions.timecode import compact_transcript, segments_to_vtt

# Languages looked for when a video has no original-language track.
FALLBACK_LANGUAGES = ("en", "en-US", "en-UK")
# Fixed value: seconds per part when a recording is too large for the provider.
PART_SECONDS = 1600


def pick_subtitle(tracks: DataFrame, keys: list[str], languages: list[str] | None = None,
                  translation: str | None = None) -> DataFrame:
    """The subtitle track of each video. ``tracks``: keys, kind (manual or auto), lang, pos.

    Manual before automatic, then by language. Without a language asked for, the
    first ``-orig`` track's language is used, else English. Plain aggregates, so
    partial ones run before the exchange.
    """
    order = F.when(F.col("kind") == "manual", 0).otherwise(1)
    ranked = tracks.withColumn("_o", order)
    if languages is None:
        first = ranked.filter(F.col("lang").endswith("-orig")).groupBy(*keys).agg(
            F.min_by("lang", F.struct("_o", "pos")).alias("_orig"))
        ranked = ranked.join(first, keys, "left")
        wanted = F.when(F.col("_orig").isNotNull(), F.array("_orig")).otherwise(F.array(*[F.lit(x) for x in FALLBACK_LANGUAGES]))
    else:
        wanted = F.array(*[F.lit(x) for x in languages])
    if translation:
        wanted = F.concat(wanted, F.array(F.lit(translation)))
    place = F.array_position(wanted, F.col("lang"))
    fit = ranked.withColumn("_p", place).filter(F.col("_p") > 0)
    chosen = fit.groupBy(*keys).agg(F.min_by(F.struct("kind", "lang"), F.struct("_o", "_p", "pos")).alias("t"))
    return chosen.select(*keys, "t.kind", "t.lang")


def transcribe(audio: DataFrame, call: Callable[[list[bytes]], list[list[dict]]], content: str = "content") -> DataFrame:
    """Recordings to text. ``call`` takes a batch of recordings and gives segments with start, end, text."""
    @F.pandas_udf("array<struct<start:double,end:double,text:string>>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(call(list(batch)))

    rows = audio.withColumn("_s", run(content)).drop(content)
    return rows.withColumn("page_content", compact_transcript(segments_to_vtt(F.col("_s")), drop_hour=False)).drop("_s")


def passes_gate(text: Column, min_tokens: int = 20) -> Column:
    from corpusmill.functions.text import est_tokens

    return text.isNotNull() & (est_tokens(text) > min_tokens)


def first_passing(candidates: dict[str, Column], min_tokens: int = 20) -> Column:
    """struct(parser, content) of the first candidate, in order, that is long enough."""
    chosen = F.when(F.lit(False), F.struct(F.lit("").alias("parser"), F.lit("").alias("content")))
    for name, text in candidates.items():
        chosen = chosen.when(passes_gate(text, min_tokens), F.struct(F.lit(name).alias("parser"), text.alias("content")))
    return chosen


def reader_text(reply: Column) -> Column:
    """Body of a reader-service reply without links and with images named."""
    return markdown_images_to_name(markdown_links_to_text(reader_body(reply)))


def fetch(urls: DataFrame, call: Callable[[list[str]], list[str]], column: str = "path", into: str = "html") -> DataFrame:
    """Fetch pages in batches inside the tasks; ``call`` is the only code that touches the network."""
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(call(list(batch)))

    return urls.withColumn(into, run(column))


def staged_fetch(urls: DataFrame, ways: list[tuple[str, Callable[[list[str]], list[str]]]], column: str = "path",
                 min_tokens: int = 20) -> DataFrame:
    """Each distinct url with what the first way that passes the gate made of it: content, stage, calls.

    A way is a name and a function of a batch of urls, which may give null; it is called only for urls that no
    earlier way has settled.
    """
    from corpusmill.operators.staged import fall_through

    def called(call):
        @F.pandas_udf("string")
        def run(batch: pd.Series) -> pd.Series:
            return pd.Series(call(list(batch)), dtype="object")

        return lambda _: run(column)

    asked = urls.select(column).where(F.col(column).isNotNull()).distinct()
    return fall_through(asked, column, [(name, called(call)) for name, call in ways],
                        lambda text: F.when(passes_gate(text, min_tokens), 1.0).otherwise(0.0)).drop("rating")
