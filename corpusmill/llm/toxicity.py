"""Toxicity by a weighted grammar over clauses.

Five small transducers read the words of a clause: insults, threats, targets
("you"), negation and reported speech. Their product is one automaton that, at
each insult or threat, knows whether a target is near, a negation precedes it or
the clause reports somebody else's words. Insults carry weights: log-odds of
word stems between toxic and clean documents, learned from labels, on top of a
short fixed list. A logistic model over the matched clauses gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.sampling import labelled_rows
from corpusmill.llm.stores import fresh, prepare

# Words of the five classes, in the four languages of the corpus.
INSULTS = ("idiot idiots moron morons clown clowns loser losers scum worthless pathetic disgusting trash "
           "stupid dumb fool imbecile scumbag vermin filth idiota imbécil estúpido basura idioten dumm "
           "abschaum trottel crétin imbécile ordure").split()
THREATS = "kill hurt destroy burn shoot stab beat hang töten umbringen tuer frapper matar golpear".split()
TARGETS = ("you your yours u ye they them those he she du dich dir ihr euch tu te toi vous usted "
           "ustedes tú vosotros").split()
NEGATIONS = ("not no never neither nor isn't aren't don't nicht kein keine nie pas jamais aucun "
             "nunca jamás ningún").split()
REPORTS = ("said says claimed wrote quoted called reported according sagte schrieb laut dit écrit "
           "selon dijo escribió según").split()

INSULT, THREAT, TARGET, NEGATION, REPORT = range(1, 6)
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSES = re.compile(r"[.!?;\n]+")
STEM = (3, 10)
EVENT_FLAGS = ("targeted", "negated", "reported")


def _window(symbol: int, steps: int):
    """A transducer that is on for ``steps`` words after ``symbol``."""
    return lambda state, read: steps if read == symbol else max(state - 1, 0)


def _latch(symbol: int):
    """A transducer that stays on after ``symbol``."""
    return lambda state, read: 1 if read == symbol else state


def compose(near: int = 4) -> tuple[list[list[int]], list[list[int]]]:
    """The product automaton: next state, and event (-1: none), by state and symbol.

    An event's number has two halves, insults and threats; within them bits say
    targeted, negated, reported.
    """
    parts = (("targeted", near, _window(TARGET, near)), ("negated", 3, _window(NEGATION, 3)),
             ("reported", 1, _latch(REPORT)))
    states = list(product(*(range(n + 1) for _, n, _ in parts)))
    number = {s: i for i, s in enumerate(states)}
    after, events = [], []
    for state in states:
        flags = sum(1 << bit for bit, on in enumerate(state) if on)
        after.append([number[tuple(step(s, read) for s, (_, _, step) in zip(state, parts, strict=True))]
                      for read in range(6)])
        events.append([{INSULT: flags, THREAT: 8 + flags}.get(read, -1) for read in range(6)])
    return after, events


@dataclass
class Grammar:
    """Word classes, stem weights and the logistic model over clause features."""

    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    weights: list[float] = field(default_factory=lambda: [0.0, 2.0, 0.6, -1.6, -1.2, 1.5, 0.8, 0.0, 0.0])

    def __post_init__(self):
        self.after, self.events = compose()
        self.fixed = {w: (s, 0.0) for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS),
                                                   (REPORT, REPORTS)) for w in words}
        self.fixed |= {w: (INSULT, 3.0) for w in INSULTS}
        self.seen: dict[str, tuple[int, float] | None] = {}

    def classify(self, raw: str) -> tuple[int, float] | None:
        """Class and weight of a word as it stands in a text; None for other words."""
        best = None
        for word in WORDS.findall(raw):
            known = self.fixed.get(word)
            if known and (best is None or known[1] > best[1]):
                best = known
            for n in range(STEM[0], min(len(word), STEM[1]) + 1):
                weight = self.stems.get(word[:n])
                if weight is not None and (best is None or best[0] != INSULT or weight > best[1]):
                    best = (INSULT, weight)
        return best

    def clauses(self, text: str) -> tuple[int, list[tuple[int, float, list[int]]]]:
        """Number of words, and of each matched clause: its number, weight and events."""
        seen, total, matched = self.seen, 0, []
        if len(seen) > 150_000:
            seen.clear()
        for number, clause in enumerate(CLAUSES.split(text.lower())):
            words = clause.split()
            total += len(words)
            try:
                marks = [seen[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in seen:
                        seen[w] = self.classify(w)
                marks = [seen[w] for w in words]
            if not any(marks):
                continue
            state, weight, events, last = 0, 0.0, [], None
            for at, mark in enumerate(marks):
                symbol, own = mark or (0, 0.0)
                event = self.events[state][symbol]
                state = self.after[state][symbol]
                if event >= 0:
                    events.append(event)
                    damp = (0.3 if event & 2 else 1.0) * (0.5 if event & 4 else 1.0)
                    weight += damp * (own if event < 8 else 1.0) * (1.3 if event & 1 else 1.0)
                    last = at
                elif symbol == TARGET and last is not None and at - last <= 2 and not events[-1] & 1:
                    events[-1] |= 1  # "idiot, you": the target follows
            if events:
                matched.append((number, weight, events))
        return total, matched

    @staticmethod
    def features(total: int, matched: list[tuple[int, float, list[int]]]) -> list[float]:
        events = Counter(e for _, _, found in matched for e in found)
        plain = sum(n for e, n in events.items() if e < 8 and not e & 6)
        weights = [w for _, w, _ in matched]
        return [min(sum(weights), 40.0) / 4, math.log1p(plain),
                math.log1p(sum(n for e, n in events.items() if e & 1 and not e & 6)),
                math.log1p(sum(n for e, n in events.items() if e & 2)),
                math.log1p(sum(n for e, n in events.items() if e & 4)),
                math.log1p(sum(n for e, n in events.items() if e >= 8 and e & 1 and not e & 6)),
                min(max(weights, default=0.0), 12.0) / 4, 20 * sum(weights) / (20 + total),
                math.log1p(total) / 8 if matched else 0.0]

    def judge(self, text: str | None) -> tuple[float, list[int]]:
        """Score of a text, and the numbers of its matched clauses."""
        total, matched = self.clauses(text or "")
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(total, matched), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [n for n, _, _ in matched]


def _count_stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents of each stem, in toxic (1) and clean (0) texts of a task."""
    words_of, docs_of = (Counter(), Counter()), (Counter(), Counter())
    for batch in batches:
        for text, label in batch[["text", "toxic"]].itertuples(index=False):
            mine = Counter()
            for word, n in Counter(WORDS.findall(text.lower())).items():
                for length in range(STEM[0], min(len(word), STEM[1]) + 1):
                    mine[word[:length]] += n
            words_of[label].update(mine)
            docs_of[label].update(mine.keys())
    stems = list(words_of[0].keys() | words_of[1].keys())
    for at in range(0, len(stems), 20_000):
        some = stems[at:at + 20_000]
        yield pd.DataFrame({"stem": some, **{f"{name}{label}": [table[label][s] for s in some] for label in (0, 1)
                                             for name, table in (("words", words_of), ("docs", docs_of))}})


def learn_stems(sample: DataFrame, least_docs: int = 3) -> dict[str, float]:
    """Stems that are surely more frequent in toxic documents, and their log-odds.

    ``sample`` is a bounded set of rows (text, toxic). The log-odds over documents,
    less two standard errors, must exceed log 4. The weight is the lower of the
    log-odds over words and over documents. All stems that pass are kept: their number
    is bounded by the words of the sample.
    """
    counted = ("words0", "words1", "docs0", "docs1")
    counts = (sample.mapInPandas(_count_stems, "stem string, " + ", ".join(f"{c} long" for c in counted))
              .groupBy("stem").agg(*(F.sum(c).alias(c) for c in counted)))
    totals = sample.groupBy("toxic").agg(F.sum(F.length("text")).alias("words"), F.count("*").alias("docs"))
    base = {r["toxic"]: r for r in totals.collect()}
    if set(base) != {0, 1} or not (base[0]["words"] and base[1]["words"]):
        return {}

    def odds(of: str):
        return (F.log((F.col(f"{of}1") + 0.5) / (F.col(f"{of}0") + 0.5))
                - math.log(base[1][of] / base[0][of]))

    error = F.sqrt(1 / (F.col("docs1") + 0.5) + 1 / (F.col("docs0") + 0.5))
    found = (counts.where(F.col("docs1") >= least_docs).withColumn("sure", odds("docs") - 2 * error)
             .where(F.col("sure") > math.log(4)).withColumn("weight", F.least(odds("docs"), odds("words")))
             .where(F.col("weight") > 0)
             .select("stem", "weight").collect())
    return {r["stem"]: min(6.0, r["weight"]) for r in found}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, list[float]]:
    """Ridge logistic regression by Newton's method."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:].tolist()


def train(labelled: DataFrame) -> Grammar:
    """Fit the grammar's weights on the rows (text, toxic) of a bounded sample.

    Rows without text or label are not used. With fewer than two rows of either label
    the fixed words and weights are used as they are.
    """
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1)).select("text", "toxic")
    grammar = Grammar(learn_stems(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"),
                                "x": [grammar.features(*grammar.clauses(t)) for t in batch["text"]]})

    # features of the bounded sample: nine numbers a row
    data = rows.mapInPandas(run, "toxic int, x array<double>").toPandas()
    y = data["toxic"].to_numpy(float) if len(data) else np.zeros(0)
    if min(y.sum(), len(y) - y.sum()) >= 2:
        order = np.lexsort([*np.array(data["x"].tolist()).T, y])  # the same sums in every run
        grammar.bias, grammar.weights = _fit(np.array(data["x"].tolist())[order], y[order])
    return grammar


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
                  most_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most_rows`` labelled documents outside the held-out fold; see ``labelled_rows``."""
    return labelled_rows(docs, labels, "toxic", folds, held_out, most_rows, seed)


def score(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_clauses`` (the numbers of matched clauses).

    A null text is scored like an empty one: the model's bias alone. Scores depend
    on the text only, so repeated rows get equal scores. The two columns replace
    columns of those names.
    """
    prepare(docs.sparkSession)
    own = docs.drop("toxicity", "toxic_clauses")
    grammar.seen.clear()

    @F.pandas_udf("struct<toxicity: double, toxic_clauses: array<int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([grammar.judge(t) for t in texts], columns=["toxicity", "toxic_clauses"])

    found, = fresh(own, "found")
    return own.withColumn(found, run(F.col(text))).select(
        *own.columns, F.col(found)["toxicity"].alias("toxicity"), F.col(found)["toxic_clauses"].alias("toxic_clauses"))
