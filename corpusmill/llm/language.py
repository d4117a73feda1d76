"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed character 1- to 3-grams, weighted by relative frequency and
inverse document frequency. Weights are fitted by follow-the-regularised-leader
with elastic-net penalties, which leaves most of them zero, and probabilities
are calibrated with one temperature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.sampling import bounded_sample
from corpusmill.llm.stores import fresh, prepare

BITS = 16
SCALE = 100.0  # keeps feature values near one
_GAPS = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_000_003)


def ngrams(text: str) -> np.ndarray | None:
    """Slots of all character 1- to 3-grams of the letters of a text; None without a letter."""
    plain = _GAPS.sub(" ", text.lower()).strip()
    if not plain:
        return None
    c = np.frombuffer(f" {plain} ".encode("utf-32-le"), "<u4").astype("u8")
    two = c[:-1] * _STEP + c[1:]
    three = two[:-1] * _STEP + c[2:]
    return (np.concatenate([c, two, three]) * _MIX >> np.uint64(64 - BITS)).astype("i8")


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if text else False


@dataclass
class Model:
    """Languages, and for each slot the weight of each language times its idf."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _has_letter(text):
            return "und", 0.0
        slots = ngrams(text)
        if slots is None:  # letters that are no word characters
            slots = np.zeros(1, "i8")
        z = (self.weights[slots].mean(axis=0) * SCALE + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each slot occurs, over all rows, and their number.

    Each task sends one row per slot: 2 ** 16 at most, whatever it has read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(1 << BITS, "i8"), 0
        for batch in batches:
            for text in batch["text"]:
                slots = ngrams(text)
                if slots is not None:
                    mine = np.zeros(1 << BITS, bool)
                    mine[slots] = True
                    seen += mine
                    n += 1
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": np.append(used, -1), "n": np.append(seen[used], n)})

    rows = (docs.select("text").where(F.col("text").isNotNull()).mapInPandas(run, "slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(1 << BITS)
    slots = rows["slot"].to_numpy()
    out[slots[slots >= 0]] = rows["n"].to_numpy()[slots >= 0]
    return out, int(rows["n"].to_numpy()[slots < 0].sum())


def _penalised(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """The weights that follow-the-regularised-leader holds for sums ``z`` and squares ``n``."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 4, alpha: float = 0.3,
             beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slots x languages) and bias from sparse rows (slots, values) and their classes."""
    size = 1 << BITS
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, values = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            zs, ns = z[slots], n[slots]
            w = _penalised(zs, ns, alpha, beta, l1, l2)
            s = values @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = values[:, None] * p[None, :]
            z[slots] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[slots] = ns + g * g
    w = _penalised(z, n, alpha, beta, l1, l2)
    return w[:-1], w[-1]


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search."""
    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    low, high, ratio = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, most_rows: int = 6000, seed: int = 3) -> Model:
    """Fit a model on (doc_id, text, lang).

    Document frequencies are counted over all rows; the weights are fitted on
    at most ``most_rows`` of them, chosen by a hash of the row, the temperature on
    every fifth of these. Repeated and null ids are no matter. Rows without text, language or letters are not used;
    without any row, the model knows no language.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    frequency, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + frequency)) + 0.1
    held = spark.sparkContext.broadcast(idf)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, lang in batch[["doc_id", "text", "lang"]].itertuples(index=False):
                slots = ngrams(text)
                if slots is not None:
                    used, n = np.unique(slots, return_counts=True)
                    values = (n / len(slots) * SCALE * held.value[used]).astype("f4")
                    out.append((doc, lang, used.astype("<i4").tobytes(), values.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "slots", "values"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = [b for b in batches if len(b)]
        if not data:
            return
        data = pd.concat(data).sort_values(["doc_id", "lang", "slots"]).reset_index(drop=True)
        languages = sorted(data["lang"].unique())
        y = data["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
        rows = [(np.frombuffer(s, "<i4").astype("i8"), np.frombuffer(v, "<f4").astype("f8"))
                for s, v in zip(data["slots"], data["values"], strict=True)]
        test = np.arange(len(rows)) % 5 == 4
        learn = np.flatnonzero(~test)
        weights, bias = fit_ftrl([rows[i] for i in learn], y[learn], len(languages))
        temperature = 1.0
        if test.any():
            z = np.array([rows[i][1] @ weights[rows[i][0]] + bias for i in np.flatnonzero(test)])
            temperature = fit_temperature(z, y[test])
        yield pd.DataFrame({"languages": [languages], "weights": [weights.astype("<f8").tobytes()],
                            "bias": [bias.astype("<f8").tobytes()], "temperature": [temperature]})

    sample = bounded_sample(known, ["doc_id", "text", "lang"], most_rows, seed)
    model = (sample.mapInPandas(features, "doc_id long, lang string, slots binary, values binary")
             .repartition(1)  # the bounded sample
             .mapInPandas(fit, "languages array<string>, weights binary, bias binary, temperature double").first())
    if model is None:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    weights = np.frombuffer(model["weights"], "<f8").reshape(1 << BITS, -1)
    return Model(list(model["languages"]), (weights * idf[:, None]).astype("f4"),
                 np.frombuffer(model["bias"], "<f8"), model["temperature"])


def predict(docs: DataFrame, model: Model, text: str | Column = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, from the text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text
    if no language was learned. Equal scores go to the first language by code
    point. The two columns replace columns of those names.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang", "score"])

    own = docs.drop("lang_pred", "lang_score")
    col = F.col(text) if isinstance(text, str) else text
    found, = fresh(own, "found")
    return own.withColumn(found, run(col)).select(
        *own.columns, F.col(found)["lang"].alias("lang_pred"), F.col(found)["score"].alias("lang_score"))
