"""Model names, prices and context sizes as a lookup table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_MODEL = "testing/testing"
DEFAULT_CONTEXT = 4096
KINDS = ("prompt", "completion", "internal_reasoning")


@dataclass(frozen=True)
class ModelName:
    """``backend/model``, with a form that is safe in file names."""

    original: str

    def __post_init__(self):
        if "/" not in self.original:
            raise ValueError(f"a model is named backend/model, got {self.original!r}")

    @property
    def backend(self) -> str:
        return self.original.split("/", 1)[0]

    @property
    def model(self) -> str:
        return self.original.split("/", 1)[1]

    @property
    def sanitised(self) -> str:
        return "".join(c if c.isalnum() else "_" for c in self.original)

    def is_testing(self) -> bool:
        return self.original == TEST_MODEL


def price_table(spark: SparkSession, prices: dict[str, dict[str, float]]) -> DataFrame:
    """(model, kind, price) rows; the test model costs nothing. Dearer kinds default to the completion price."""
    rows = [(TEST_MODEL, kind, 0.0) for kind in KINDS]
    for model, known in prices.items():
        if "prompt" not in known or "completion" not in known:
            raise ValueError(f"{model} needs a prompt and a completion price")
        rows += [(model, kind, float(known.get(kind, known["completion"]))) for kind in KINDS]
    return spark.createDataFrame(rows, "model string, kind string, price double")


def prices_of(table: DataFrame, model: str) -> DataFrame:
    found = table.filter(F.col("model") == model).select("kind", "price")
    if found.isEmpty():
        raise ValueError(f"no price is known for {model!r}")
    return found


def supported(requested: dict, known: set[str]) -> dict:
    """Model arguments the provider knows; the others are dropped."""
    return {k: v for k, v in requested.items() if k in known}
