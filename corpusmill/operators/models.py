"""Model calls behind small interfaces, with deterministic stand-ins that need no network.

A model is a function of columns. A provider's client goes in through
:func:`python_model`, which hands whole Arrow batches to a Python function.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.let import let
from corpusmill.functions.text import CHARS_PER_TOKEN, strip

ANSWER_TOKENS = 4_000
EMBEDDING_WIDTH = 64


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Evaluator(Protocol):
    def __call__(self, question: Column, text: Column) -> Column: ...


class Answerer(Protocol):
    def __call__(self, question: Column, text: Column) -> Column: ...


def python_model(call: Callable[..., list], returns: str) -> Callable[..., Column]:
    """Wrap a function of equally long lists as a model. ``call`` may batch its requests as it likes."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(call(*[list(c) for c in columns]))

    def model(*columns: Column) -> Column:
        return run(*columns)

    model.in_python = True  # cannot stand inside a lambda of the optimizer
    return model


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def hash_embedding(text: Column, width: int = EMBEDDING_WIDTH) -> Column:
    """Stand-in embedder: counts of hashed words, at unit length. Blank text is refused."""
    checked = F.when(strip(text) == "", F.raise_error(F.lit("cannot embed an empty text"))).otherwise(text)
    cells = F.transform(words(checked), lambda w: F.pmod(F.xxhash64(w), F.lit(2 * width)).cast("int"))

    @F.pandas_udf("array<double>")
    def count(series: pd.Series) -> pd.Series:
        def one(cells_of_text):
            counts = np.bincount(np.asarray(cells_of_text, dtype=np.int64), minlength=2 * width).astype(float)
            signed = counts[:width] - counts[width:]
            size = np.linalg.norm(signed)
            return signed / size if size else signed

        return series.map(one)

    return count(cells)


def overlap_votes(question: Column, text: Column, n_votes: int = 3) -> Column:
    """Stand-in evaluator: share of the question's words in the text, 0 to 10.

    The n-th vote only looks at words longer than n letters, so votes differ.
    """
    asked = F.array_distinct(words(question))

    def longer(listed: Column, n: int) -> Column:
        return F.size(F.filter(listed, lambda w: F.length(w) > n))

    def votes(hits: Column) -> Column:
        return F.array(*[F.when(longer(asked, n) > 0, F.floor(10 * longer(hits, n) / longer(asked, n)).cast("int"))
                         for n in range(1, n_votes + 1)])

    return let(F.array_intersect(asked, words(text)), votes)


def first_sentence_answer(question: Column, text: Column) -> Column:
    """Stand-in answerer: the first sentence that shares a word with the question, within the token cap."""
    asked = F.filter(words(question), lambda w: F.length(w) > 1)
    sentences = F.split(text, r"(?<=[.!?])\s+")
    hit = F.get(F.filter(sentences, lambda s: F.arrays_overlap(words(s), asked)), F.lit(0))
    return F.coalesce(F.substring(hit, 1, int(ANSWER_TOKENS * CHARS_PER_TOKEN)), F.lit("<answer>IRRELEVANT</answer>"))


def first_words_summary(chunk: Column, previous: Column) -> Column:
    """Stand-in summariser: a bullet per sentence with its first words, unless the last chunk said so already."""
    sentences = F.filter(F.split(chunk, r"(?<=[.!?])\s+|\n"), lambda s: s.rlike(r"\p{L}"))
    bullets = F.transform(sentences, lambda s: F.concat(
        F.lit("- "), F.array_join(F.slice(F.split(F.trim(s), r"\s+", 7), 1, 6), " ")))
    return F.array_join(F.filter(F.array_distinct(bullets), lambda b: ~F.array_contains(previous, b)), "\n")


def tags_in(answer: Column) -> Column:
    """Tags a model listed between its markers, one per line, shortest first."""
    block = F.regexp_extract(answer, r"(?s)<tags>(.*?)</tags>", 1)
    tags = F.filter(F.transform(F.split(block, "\n"), lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(F.array_sort(F.transform(tags, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))),
                       lambda s: s["t"])


def votes_with_cache(pairs: DataFrame, cache: DataFrame, evaluate: Evaluator) -> DataFrame:
    """Votes per (question, text), asking the model only for pairs the cache lacks.

    ``pairs``: key, question, text, and whatever else to keep. ``cache``: key, votes.
    """
    missing = pairs.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    fresh = missing.select("key", evaluate(F.col("question"), F.col("text")).alias("votes"))
    return pairs.join(cache.unionByName(fresh), "key")
