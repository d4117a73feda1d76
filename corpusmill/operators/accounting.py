"""Tokens, prices, reading time and load results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The model behind the cost estimate of a summary.
COMPRESSION = 0.28
PROMPT_TOKENS = 1000
TOKEN_KINDS = ("prompt", "completion", "internal_reasoning")


def tokens_per_path(chunks: DataFrame) -> DataFrame:
    """Tokens of each path, and of all of them in the row without a path."""
    return chunks.rollup("path").agg(F.sum("tkn_length").alias("tokens"))


def display_price(tokens: Column, prompt_price: float, completion_price: float) -> Column:
    return tokens * (prompt_price * 4 + completion_price) / 5


def summary_cost(tokens: Column, prompt_price: float, completion_price: float, n_recursion: int = 0) -> Column:
    """Estimated cost of summarising, with one shrinking pass per recursion."""
    read = (tokens + PROMPT_TOKENS) * prompt_price
    written = tokens * COMPRESSION * completion_price
    total = read + written
    for i in range(n_recursion):
        total = total + read * COMPRESSION ** i + tokens * COMPRESSION ** (i + 1) * completion_price
    return total


def usage_cost(usage: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Cost per key from token counts by kind. ``usage``: keys, kind, tokens. ``prices``: kind, price."""
    per_kind = usage.groupBy(*keys, "kind").agg(F.sum("tokens").alias("tokens"))
    return (per_kind.join(prices, "kind").groupBy(*keys)
            .agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("price")).alias("cost")))


def check_spend(estimate: float, limit: float, own_endpoint: bool = False) -> None:
    """Stop above the limit, unless the endpoint is the user's own."""
    if estimate > limit and not own_endpoint:
        raise ValueError(f"estimated cost {estimate:.2f} is above the limit of {limit:.2f}")


def audit_tags(asked: DataFrame, loaded: DataFrame) -> DataFrame:
    """Asked tags against loaded ones. ``asked``: tag. ``loaded``: tag, failed.

    Counts are combined before the outer join, so the join sees one row per tag.
    """
    counts = loaded.groupBy("tag").agg(F.count_if(~F.col("failed")).alias("n_ok"),
                                       F.count_if(F.col("failed")).alias("n_failed"))
    wanted = asked.distinct().withColumn("_asked", F.lit(True))
    both = wanted.join(counts, "tag", "full_outer")
    n_ok = F.coalesce("n_ok", F.lit(0))
    state = F.when(F.col("_asked").isNull(), "extra").when(n_ok == 0, "missing").otherwise("ok")
    return both.select("tag", n_ok.alias("n_ok"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), state.alias("state"))


def pick_best(candidates: Column) -> Column:
    """Best of the ordered parses of a file: array of struct(name, content, prob).

    Parses below one half do not count; the search stops at the first above 0.95
    or after three that count. NULL when none does.
    """
    good = F.filter(candidates, lambda c: c["prob"] >= 0.5)

    def choose(kept: Column) -> Column:
        sure = F.filter(F.transform(kept, lambda c, i: F.when(c["prob"] > 0.95, i + 1)), lambda i: i.isNotNull())
        looked = F.slice(kept, F.lit(1), F.least(F.lit(3), F.coalesce(F.array_min(sure), F.lit(3))))
        top = F.array_max(F.transform(looked, lambda c: c["prob"]))
        return F.get(F.filter(looked, lambda c: c["prob"] == top), F.lit(0))

    return F.get(F.transform(F.array(good), choose), F.lit(0))
