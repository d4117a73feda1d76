"""Finding a known name from a misspelt one, without comparing all pairs.

An exact hit is a join. A prefix hit is a join with the beginnings of the known names, cut
at lengths that are asked for. What is left is looked up by edit distance d = 1, 2, ...: if a
known name is cut into d + 1 even segments, d edits leave one of them whole, moved by at most d. So
the segments are join keys, and only names that are still open go on to the next d. A name
whose distance leaves segments too short to tell names apart is settled by its letter counts: it
meets the signatures that occur, whose bounds say which names are compared at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.lineage import checkpointed

# Segments shorter than this are in too many names to be looked up by.
LEAST_SEGMENT = 3


def closest_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Each row of ``wanted`` (column ``wanted`` and others) with the known name it means.

    ``known`` is a catalogue of names (column ``name``); repeated and null ones are no
    matter. An exact name wins, else the only name that starts with the wanted one, else the
    closest by edit distance, the smallest of equally close ones. A null name wanted, or an
    empty catalogue, gives a null name.
    """
    names = checkpointed(known.where(F.col("name").isNotNull()).select("name").distinct())
    asked = checkpointed(wanted.where(F.col("wanted").isNotNull()).select("wanted").distinct())
    exact = asked.join(names, asked["wanted"] == names["name"]).select("wanted", "name")
    rest = asked.join(exact.select("wanted"), "wanted", "left_anti")
    lengths = [r["n"] for r in asked.select(F.length("wanted").alias("n")).distinct().collect()]
    beginnings = names.select("name", F.explode(F.array(*(F.lit(n) for n in sorted(lengths)))).alias("n")).where(
        F.length("name") >= F.col("n")).select(F.expr("substring(name, 1, n)").alias("wanted"), "name")
    started = rest.join(beginnings, "wanted").groupBy("wanted").agg(F.count("*").alias("n"), F.min("name").alias("name")).where(
        "n = 1").select("wanted", "name")
    done = checkpointed(exact.unionByName(started))
    opened = checkpointed(rest.join(started.select("wanted"), "wanted", "left_anti"))
    distance = 1
    while not opened.isEmpty():
        found, usable = _within(opened, names, distance)
        done = done.unionByName(found)
        left = checkpointed(opened.join(found.select("wanted"), "wanted", "left_anti"))
        # too short segments would join all with all; those names are left to the bounds
        far = left.where(F.length("wanted") < LEAST_SEGMENT * (distance + 2)) if usable else left
        if not usable or not far.isEmpty():
            done = done.unionByName(_by_bounds(far, names))
        opened = left.where(F.length("wanted") >= LEAST_SEGMENT * (distance + 2)) if usable else left.where("false")
        distance += 1
    keys = wanted.columns
    return wanted.join(done.withColumnRenamed("wanted", "_w"), F.col("wanted") == F.col("_w"), "left").select(*keys, "name")


def _segments(text: Column, parts: int) -> Column:
    """Array of (number, start from 1, segment) of a text cut evenly."""
    n = F.length(text)
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(
        i.alias("number"), F.substr(text, F.floor(i * n / parts).cast("int") + 1,
                                    (F.floor((i + 1) * n / parts) - F.floor(i * n / parts)).cast("int")).alias("segment")))


def _within(opened: DataFrame, names: DataFrame, distance: int) -> tuple[DataFrame, bool]:
    """The closest known name of each open one, where it is at most ``distance`` away."""
    parts = distance + 1
    cut = names.where(F.length("name") >= parts).select(
        "name", F.length("name").alias("size"), F.explode(_segments(F.col("name"), parts)).alias("s")).select(
            "name", "size", "s.number", "s.segment")
    if names.where(F.length("name") >= LEAST_SEGMENT * parts).isEmpty():
        return opened.select("wanted", F.lit(None).cast("string").alias("name")).where("false"), False
    moved = opened.select("wanted", F.explode(F.sequence(
        F.greatest(F.length("wanted") - distance, F.lit(parts)), F.greatest(F.length("wanted") + distance, F.lit(parts)))).alias("size"))
    probes = moved.select("wanted", "size", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("number")).select(
        "wanted", "size", "number", F.explode(F.sequence(F.lit(-distance), F.lit(distance))).alias("shift"))
    start = F.floor(F.col("number") * F.col("size") / parts).cast("int")
    length = (F.floor((F.col("number") + 1) * F.col("size") / parts)).cast("int") - start
    probes = probes.where((start + F.col("shift") >= 0) & (start + F.col("shift") + length <= F.length("wanted"))).select(
        "wanted", "size", "number", F.substr("wanted", start + F.col("shift") + 1, length).alias("segment")).distinct()
    pairs = probes.join(cut, ["size", "number", "segment"]).select("wanted", "name").distinct()
    # names too short to be cut hold few letters: at most ``distance`` of them
    short = names.where(F.length("name") < parts)
    near = opened.where(F.length("wanted") <= parts - 1 + distance)
    pairs = pairs.unionByName(near.join(short, F.abs(F.length("wanted") - F.length("name")) <= distance).select("wanted", "name"))
    far = F.levenshtein("wanted", "name", distance)
    close = pairs.withColumn("far", far).where(F.col("far") >= 0)
    return checkpointed(close.groupBy("wanted").agg(F.min(F.struct("far", "name")).alias("b")).select("wanted", "b.name")), True


def _signature(text: Column) -> Column:
    """How often letters of each of three kinds occur. An edit raises at most one count by one and lowers
    at most one; names of up to n letters have fewer than n cubed signatures, however many they are."""
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.size(F.filter(F.split(text, ""), lambda c: F.pmod(F.ascii(c), F.lit(3)) == k)))


def _by_bounds(opened: DataFrame, names: DataFrame) -> DataFrame:
    """The closest known name of each open one, however far.

    Known names of equal signature are one group; the least number of edits between two
    signatures bounds the distance of all its names. A first closest name comes from the group of the
    least bound; then only groups whose bound does not exceed its distance are compared.
    """
    grouped = names.withColumn("signature", _signature(F.col("name")))
    groups = checkpointed(grouped.groupBy("signature").agg(F.min("name").alias("one")))
    rows = opened.withColumn("own", _signature(F.col("wanted")))
    more = F.aggregate(F.zip_with("own", "signature", lambda a, b: F.greatest(a - b, F.lit(0))), F.lit(0), lambda s, x: s + x)
    less = F.aggregate(F.zip_with("own", "signature", lambda a, b: F.greatest(b - a, F.lit(0))), F.lit(0), lambda s, x: s + x)
    bound = F.greatest(more, less)
    # signatures, not names, meet: there are few, whatever the catalogue holds
    bounded = checkpointed(rows.join(groups, F.lit(True)).select("wanted", "signature", "one", bound.alias("bound")))
    first = bounded.groupBy("wanted").agg(F.min(F.struct("bound", "one")).alias("b")).select(
        "wanted", F.levenshtein("wanted", F.col("b.one")).alias("most"))
    worth = bounded.join(first, "wanted").where(F.col("bound") <= F.col("most")).select("wanted", "signature")
    pairs = worth.join(grouped.select("signature", "name"), "signature")
    best = pairs.groupBy("wanted").agg(F.min(F.struct(F.levenshtein("wanted", "name").alias("far"), "name")).alias("b"))
    return checkpointed(best.select("wanted", "b.name"))
