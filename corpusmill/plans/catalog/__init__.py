"""All registered queries, each next to the SQL that checks it."""

from __future__ import annotations

import importlib

from corpusmill import registry

MODULES = ("text", "sources", "filters", "vectors", "chunks", "aggregates", "evaluation", "mechanisms", "tasks")


def load():
    """Import every module of the catalog and return (queries, oracle SQL)."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES
