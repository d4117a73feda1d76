"""Settings, read from the Spark session on every access."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

PREFIX = "corpusmill."


@dataclass(frozen=True)
class Setting:
    kind: type
    default: Any
    frozen: bool = False


# The settings there are, with their types and defaults.
SETTINGS = {
    "private": Setting(bool, False, frozen=True),
    "vector_backend": Setting(str, "flat"),
    "max_chunk_tokens": Setting(int, 16_000),
    "max_embed_tokens": Setting(int, 7_000),
    "batch_bucket_tokens": Setting(int, 2_000),
    "intermediate_answer_tokens": Setting(int, 4_000),
    "model_concurrency": Setting(int, 1),
    "model_timeout_seconds": Setting(int, 600),
    "cache_days": Setting(int, 0),
    "eval_votes": Setting(int, 3),
    "top_k": Setting(str, "auto_200_500"),
    "dollar_limit": Setting(int, 5),
    "on_useless_path_rule": Setting(str, "warn"),
    "on_invalid_score": Setting(str, "unknown"),
}


def parse(text: str) -> Any:
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("none", ""):
        return None
    return int(text) if text.isdigit() else text


class Config:
    """``Config(spark).top_k`` reads ``corpusmill.top_k``; unknown names and wrong types are errors."""

    def __init__(self, spark: SparkSession):
        object.__setattr__(self, "_spark", spark)

    def __getattr__(self, name: str) -> Any:
        if name not in SETTINGS:
            raise AttributeError(f"no setting {name!r}; known: {sorted(SETTINGS)}")
        setting = SETTINGS[name]
        raw = self._spark.conf.get(PREFIX + name, None)
        value = setting.default if raw is None else parse(raw)
        if value is not None and type(value) is not setting.kind:
            raise TypeError(f"setting {name!r} must be {setting.kind.__name__}, got {raw!r}")
        return value

    def __setattr__(self, name: str, value: Any) -> None:
        if name not in SETTINGS:
            raise AttributeError(f"no setting {name!r}")
        if SETTINGS[name].frozen and getattr(self, name) and not value:
            raise PermissionError(f"setting {name!r} cannot be taken back")
        if type(value) is not SETTINGS[name].kind:
            raise TypeError(f"setting {name!r} must be {SETTINGS[name].kind.__name__}")
        self._spark.conf.set(PREFIX + name, str(value))
