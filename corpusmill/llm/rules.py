"""Quality by a sparse ensemble of rules over document statistics.

Boosted small trees propose rules: every path from a root is a conjunction of bounds
on statistics. A lasso logistic regression keeps few of them, and what is left is
compiled to one Spark column expression over the statistics' columns.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.sampling import labelled_rows
from corpusmill.llm.stores import fresh, prepare

STATISTICS = ("characters", "words", "word_length", "longest_word", "upper_share", "digit_share", "mark_share",
              "symbol_share", "other_share", "symbol_words", "upper_words", "distinct_words", "top_word", "lines",
              "line_words", "repeated_lines", "ended_lines", "words_a_sentence")
_MARKS = ".,;:!?'\"-()"


def _kind(b: int) -> int:
    """The class of a byte: letters a and A, digits 0, spaces, marks, symbols, and parts of other letters."""
    c = chr(b)
    if b >= 128:
        return ord("x")
    if c.isalpha():
        return ord("a") if c.islower() else ord("A")
    return ord("0" if c.isdigit() else " " if c.isspace() else "." if c in _MARKS else "#")


_KINDS = bytes(map(_kind, range(256)))


def statistics_of(text: str) -> tuple[float, ...]:
    """The statistics of a whole text; shares are 0 where there is nothing to share."""
    raw = text.encode()
    kinds = raw.translate(_KINDS)
    lower, upper, digits, marks, symbols, other = (kinds.count(k) for k in (b"a", b"A", b"0", b".", b"#", b"x"))
    solid = max(lower + upper + digits + marks + symbols + other, 1)
    words = text.split()
    n = max(len(words), 1)
    seen = Counter(words)
    lines = [line.strip() for line in text.split("\n")]
    lines = [line for line in lines if line]
    sentences = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    shaped = Counter(kinds.translate(None, b"0.#x").split())    # runs of small and capital letters, a word each
    return (float(len(text)), float(len(words)), (len(text) - text.count(" ")) / n, float(max(map(len, seen), default=0)),
            upper / max(lower + upper, 1), digits / solid, marks / solid, symbols / solid, other / solid,
            len(kinds.translate(None, b"aA0.x").split()) / n,
            sum(times for s, times in shaped.items() if len(s) > 1 and b"a" not in s) / n,
            len(seen) / n, max(seen.values(), default=0) / n, float(len(lines)), len(words) / max(len(lines), 1),
            (len(lines) - len(set(lines))) / max(len(lines), 1), sum(line[-1] in ".!?" for line in lines) / max(len(lines), 1),
            len(words) / max(sentences, 1))


def with_statistics(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``df`` with a struct ``name`` of the statistics of each text; null is like empty."""
    prepare(df.sparkSession)

    @F.pandas_udf("struct<" + ", ".join(f"{s}: double" for s in STATISTICS) + ">")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t or "") for t in texts], columns=STATISTICS)

    return df.withColumn(name, run(F.col(text)))


Rule = tuple[tuple[int, float, float], ...]   # (statistic, above, up to), all of which hold


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, low, high in rule:
        out &= (x[:, s] > low) & (x[:, s] <= high)
    return out


def _split(bins: np.ndarray, rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, widths: list[int],
           least_rows: int, ridge: float) -> tuple[float, int, int]:
    """The best (gain, statistic, bin) to split ``rows`` at; gain 0 if none."""
    best = (0.0, -1, -1)
    g, h = gradient[rows], hessian[rows]
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for s, width in enumerate(widths):
        b = bins[rows, s]
        gs, hs, n = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g, h, np.ones(len(rows))))
        gain = gs ** 2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - whole
        gain[(n < least_rows) | (len(rows) - n < least_rows)] = 0
        if len(gain) and gain.max() > best[0] + 1e-9:
            best = (float(gain.max()), s, int(gain.argmax()))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, edges: int = 64,
               least_rows: int = 10, ridge: float = 1.0) -> list[Rule]:
    """Paths of boosted trees over ``x`` as rules, in order of growth; equal ones once."""
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, edges + 1)[1:-1], method="lower")) for s in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(cuts)], axis=1)
    widths, z, rules = [len(c) + 1 for c in cuts], np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        gradient, hessian = y - p, p * (1 - p)
        nodes = [((), np.arange(len(y)), 0)]
        while nodes:
            path, rows, level = nodes.pop()
            gain, s, at = _split(bins, rows, gradient, hessian, widths, least_rows, ridge) if level < depth else (0, 0, 0)
            if gain <= 1e-6:
                z[rows] += rate * gradient[rows].sum() / (hessian[rows].sum() + ridge)
                continue
            left = bins[rows, s] <= at
            cut = float(cuts[s][at])
            for bound, side in (((-math.inf, cut), left), ((cut, math.inf), ~left)):
                spans = {k: (low, high) for k, low, high in path}
                low, high = spans.get(s, (-math.inf, math.inf))
                spans[s] = (max(low, bound[0]), min(high, bound[1]))
                rule = tuple((k, *spans[k]) for k in sorted(spans))
                rules.setdefault(rule)
                nodes.append((rule, rows[side], level + 1))
    return list(rules)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None,
          rounds: int = 30, inner: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights, the first a free bias, with an L1 penalty on the others.

    Each round bounds the loss by a parabola at the present weights and lowers that one weight
    after another, as far as its slope exceeds the penalty. ``weight``: how often each row counts.
    """
    a = np.hstack([np.ones((len(x), 1)), x])
    share = (np.ones(len(a)) if weight is None else weight) / (len(a) if weight is None else weight.sum())
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = a.T @ (a * (share * np.maximum(p * (1 - p), 1e-5))[:, None])
        slope, size = a.T @ (share * (p - y)), np.maximum(np.diag(curve), 1e-12)
        step = np.zeros(len(w))
        for _ in range(inner):
            most = 0.0
            for j in np.flatnonzero((w + step != 0) | (np.abs(slope) > penalty) | (np.arange(len(w)) == 0)).tolist():
                now = w[j] + step[j]
                wish = now - slope[j] / size[j]
                if j:
                    wish = math.copysign(max(abs(wish) - penalty / size[j], 0.0), wish)
                if wish != now:
                    step[j] += wish - now
                    slope += curve[j] * (wish - now)
                    most = max(most, abs(wish - now) * math.sqrt(size[j]))
            if most < 1e-5:
                break
        here, length = _loss(w, x, y, share) + penalty * np.abs(w[1:]).sum(), 1.0
        while length > 1e-3:  # a step that does not pay is shortened
            tried = w + length * step
            if _loss(tried, x, y, share) + penalty * np.abs(tried[1:]).sum() <= here + 1e-12:
                break
            length /= 2
        w = w + length * step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _loss(w: np.ndarray, x: np.ndarray, y: np.ndarray, share: np.ndarray | None = None) -> float:
    z = np.clip(w[0] + x @ w[1:], -30, 30)
    loss = np.log1p(np.exp(z)) - y * z
    return float(loss.mean() if share is None else share @ loss)


def _patterns(rules: list[Rule], x: np.ndarray, y: np.ndarray) -> tuple[list[Rule], np.ndarray, np.ndarray, np.ndarray]:
    """Rules that cover different rows, and the rows that differ by them: coverage, label, how many."""
    kept: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in rules:
        on = covers(rule, x)
        kept.setdefault(on.tobytes(), (rule, on))
    table = np.stack([on for _, on in kept.values()] + [y > 0.5], axis=1)
    rows, times = np.unique(table, axis=0, return_counts=True)
    return [r for r, _ in kept.values()], rows[:, :-1].astype(float), rows[:, -1].astype(float), times.astype(float)


@dataclass
class Ensemble:
    """Rules and their weights; without rules the score is that of the bias."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * covers(r, x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def expression(self, statistics: str) -> Column:
        """The score as a Spark expression over a struct of statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for s, low, high in rule:
                value = F.col(statistics)[STATISTICS[s]]
                if low > -math.inf:
                    holds = holds & (value > F.lit(low))
                if high < math.inf:
                    holds = holds & (value <= F.lit(high))
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def text(self) -> list[str]:
        """The rules in words, heaviest first."""
        return [f"{w:+.3f} if " + " and ".join(
            (f"{low:.4g} < " if low > -math.inf else "") + STATISTICS[s] + (f" <= {high:.4g}" if high < math.inf else "")
            for s, low, high in r) for r, w in sorted(self.rules, key=lambda p: -abs(p[1]))]


def fit(x: np.ndarray, y: np.ndarray, penalties: tuple[float, ...] = (0.03, 0.01, 0.003, 0.001, 0.0003)) -> Ensemble:
    """Grow rules and weigh them; the penalty is the one of the least loss on every fourth row, learned on the others.

    With fewer than two rows of either label the score is one half for every document.
    """
    order = np.lexsort([*x.T, y]) if len(x) else np.zeros(0, "i8")   # the same sums in every run
    x, y = x[order], y[order].astype(float)
    if len(y) == 0 or min(y.sum(), len(y) - y.sum()) < 2:
        return Ensemble()
    here = np.arange(len(y)) % 4 == 3
    best, grown = len(penalties) - 1, grow_rules(x[~here], y[~here]) if here.any() else []
    if grown:
        rules, on, label, times = _patterns(grown, x[~here], y[~here])
        seen, w, losses = np.stack([covers(r, x[here]) for r in rules], axis=1).astype(float), None, []
        for penalty in penalties:
            w = lasso(on, label, penalty, w, weight=times)
            losses.append(_loss(w, seen, y[here]))
        best = int(np.argmin(losses))
    grown = grow_rules(x, y)
    if not grown:
        return Ensemble(bias=math.log(y.mean() / (1 - y.mean())))
    rules, on, label, times = _patterns(grown, x, y)
    w = None
    for penalty in penalties[:best + 1]:
        w = lasso(on, label, penalty, w, weight=times)
    return Ensemble(float(w[0]), [(r, float(v)) for r, v in zip(rules, w[1:], strict=True) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0,
          most_rows: int = 10_000) -> Ensemble:
    """Learn from at most ``most_rows`` labelled documents outside the held-out fold (see ``labelled_rows``).

    Their statistics, 18 numbers a row, come to the driver; texts do not.
    """
    rows = labelled_rows(docs, labels, label, folds, held_out, most_rows)
    data = with_statistics(rows, "statistics").select(label, "statistics.*").toPandas()
    return fit(data[list(STATISTICS)].to_numpy(float), data[label].to_numpy(float))


def score(docs: DataFrame, ensemble: Ensemble, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of each row's text in a column ``name``, which replaces one of that name.

    Null and empty texts have the score of a text without words. Scores depend on the text
    alone, so repeated rows get equal scores. No rows give none.
    """
    own = [c for c in docs.columns if c.lower() != name.lower()]
    statistics, = fresh(docs, "statistics")
    return with_statistics(docs, statistics, text).select(*own, ensemble.expression(statistics).alias(name))
