"""What happens when a document cannot be loaded: an error column, not an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import doc_reading_time, est_tokens
from corpusmill.operators.documents import MAX_TOKENS, MIN_READING_MINUTES, MIN_TOKENS


def with_load_errors(docs: DataFrame) -> DataFrame:
    """Mark single-chunk documents that are empty, too small, too large or too quick to read."""
    body = F.col("page_content")
    error = (F.when(body.isNull() | ~body.rlike(r"\S"), "empty document")
             .when(est_tokens(body) <= MIN_TOKENS, "too few tokens")
             .when(est_tokens(body) >= MAX_TOKENS, "too many tokens")
             .when(doc_reading_time(body) <= MIN_READING_MINUTES, "too short to read"))
    return docs.withColumn("load_error", error)


def loaded(docs: DataFrame, on_failure: str = "warn") -> DataFrame:
    """Documents without an error; ``crash`` refuses the first failure, all failing is always refused."""
    if on_failure not in ("warn", "crash"):
        raise ValueError("on_failure is warn or crash")
    good = docs.filter(F.col("load_error").isNull())
    if on_failure == "crash":
        failed = docs.filter(F.col("load_error").isNotNull()).select("load_error").first()
        if failed:
            raise ValueError(f"a document could not be loaded: {failed['load_error']}")
    if good.isEmpty():
        raise ValueError("no document was loaded")
    return good.drop("load_error")
