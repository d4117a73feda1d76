"""Short names that still tell sources apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.lineage import checkpointed


def shortest_suffixes(sources: DataFrame, path: str = "path") -> DataFrame:
    """Each distinct path with its shortest trailing part that no other path ends with.

    Labels are whole parts; whether another path ends with one is settled by its own trailing
    parts, of which the first may be cut. So paths meet on what follows their last, second
    last, ... separator, and only those that share that (and are still open) compare the part
    before it: by its endings at the lengths that the labels have there. Rows are in proportion to parts.
    """
    paths = checkpointed(sources.select(path).distinct())
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    cut = checkpointed(paths.select(path, F.reverse(F.split(path, "/")).alias("raw"), F.reverse(parts).alias("parts")))
    deepest = cut.agg(F.max(F.size("parts"))).first()[0] or 0
    opened = cut.where(F.size("parts") > 0).select(path, "parts")
    found = None
    for depth in range(1, deepest + 1):
        # a label is the part at ``depth`` and, joined by single separators, those behind it
        asked = opened.where(F.size("parts") >= depth).select(
            path, F.array_join(F.reverse(F.slice("parts", 1, depth - 1)), "/").alias("behind") if depth > 1 else F.lit("").alias("behind"),
            F.col("parts")[depth - 1].alias("part"), F.length(F.col("parts")[depth - 1]).alias("n"))
        asked = checkpointed(asked)
        # of every path: what lies behind the separator, and the piece before it
        given = cut.where(F.size("raw") >= depth).select(
            (F.array_join(F.reverse(F.slice("raw", 1, depth - 1)), "/") if depth > 1 else F.lit("")).alias("behind"),
            F.col("raw")[depth - 1].alias("piece"), F.lit(1).alias("one"))
        lengths = asked.select("behind", "n").distinct()
        ends = given.join(lengths, "behind").where(F.length("piece") >= F.col("n")).select(
            "behind", F.expr("substring(piece, length(piece) - n + 1, n)").alias("part"))
        counts = ends.groupBy("behind", "part").agg(F.count("*").alias("sharing"))
        settled = asked.join(counts, ["behind", "part"]).where("sharing = 1").select(
            path, F.when(F.col("behind") == "", F.col("part")).otherwise(F.concat_ws("/", "part", "behind")).alias("label"))
        settled = checkpointed(settled)
        found = settled if found is None else found.unionByName(settled)
        opened = checkpointed(opened.join(settled.select(path), path, "left_anti"))
        if opened.isEmpty():
            break
    if found is None:
        return paths.withColumn("label", F.col(path))
    return paths.join(found, path, "left").withColumn("label", F.coalesce("label", path))
