"""Walks over parent-child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.lineage import checkpointed


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, key, depth) of every node below each root, the root itself at depth 0.

    ``edges``: key, parent. ``roots``: key. A level is joined to the edges at a
    time and stored, each node with the way that leads to it; a node on its own way is
    a cycle, which is an error. There is no limit to the depth.
    """
    level = checkpointed(roots.select(F.col("key").alias("root"), "key", F.array("key").alias("way")))
    found, depth = level.select("root", "key", F.lit(0).alias("depth")), 0
    while True:
        depth += 1
        above = level.select("root", F.col("key").alias("parent"), "way")
        level = checkpointed(edges.select("key", "parent").join(above, "parent").select(
            "root", "key", F.array_contains("way", F.col("key")).alias("again"),
            F.concat("way", F.array("key")).alias("way")))
        state = level.agg(F.count("*").alias("n"), F.max("again").alias("again")).first()
        if state["again"]:
            raise ValueError("the tree holds a cycle")
        if state["n"] == 0:
            return found
        found = found.unionByName(level.select("root", "key", F.lit(depth).alias("depth")))


def resolve_path(collections: DataFrame, parts: list[str]) -> str:
    """Key of a nested collection. ``collections``: key, name, parent; one indexed lookup per part."""
    if not parts:
        raise ValueError("empty collection path")
    parent = None
    for part in parts:
        under = F.col("parent").isNull() if parent is None else F.col("parent") == parent
        row = collections.filter((F.col("name") == part) & under).select("key").sort("key").first()
        if row is None:
            raise ValueError(f"no collection {part!r} below {parent!r}")
        parent = row["key"]
    return parent
