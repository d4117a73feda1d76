"""Near-identical vectors, without comparing all pairs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.vectors import dot, l2_normalise
from corpusmill.operators.bounded import fits
from corpusmill.operators.lineage import checkpointed

# Directions of a sketch, seven to a number with eight bits each and one to spare, and the steps that make a reach.
AXES, STEPS, HALF, FIELD = 14, 7, 7, 9
# The grid is cut along so many further directions where its cells hold more rows than this; a cell is 32 steps wide.
CUT_AXES, CUT_ROWS = 3, 2_048
# Rows of a tile: of vectors, and of sketches.
CELL_ROWS, SKETCH_ROWS = 1_024, 16_384
# Vectors that rows alike in all directions are held against first, where there are more of them than this.
PIVOTS, ALIKE_ROWS = 32, 128
# The most cells, the most vectors held against, and the most rows of four numbers whose table is shipped to the vectors.
SHIPPED_CELLS, SHIPPED_PIVOTS, SHIPPED_ROWS = 100_000, 30_000, 1_000_000


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _each(value: int) -> Column:
    """A number that holds ``value`` for each direction."""
    return _long(sum(value << FIELD * at for at in range(HALF)))


def _steps(vector: Column, axis: int, reach: float) -> Column:
    """Length of the vector along one fixed direction, a run of components alike, in steps modulo 256; null for null or NaN."""
    width = F.greatest(F.ceil(F.size(vector) / AXES), F.lit(1)).cast("int")
    share = F.aggregate(F.slice(vector, width * axis + 1, width), F.lit(0.0), lambda s, x: s + x) / F.sqrt(width)
    return F.when(~F.isnan(share), F.pmod(F.floor(share * (STEPS / reach)), F.lit(256)).cast("bigint"))


def _sketch(vector: Column, reach: float, half: int) -> Column:
    """Seven of the lengths in one number."""
    return reduce(Column.bitwiseOR, (F.shiftleft(_steps(vector, HALF * half + at, reach), FIELD * at) for at in range(HALF)))


def _may_be_near(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """True unless two vectors lie further apart than a reach along one of the directions."""
    def within(x: Column, y: Column) -> Column:
        # seven differences at once: the spare bits keep them apart, and 15 steps from -7 have no bit of 16 or more
        apart = (x.bitwiseOR(_each(256)) - y).bitwiseAND(_each(255)) + _each(STEPS)
        return apart.bitwiseAND(_each(0xF0)) == 0

    return within(a[0], b[0]) & within(a[1], b[1])


def _still_near(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """True unless two vectors lie further apart than a reach along all directions together."""
    def sure(x: Column, y: Column) -> Column:
        """Sum of squares; steps are rounded, so of each difference one may be none."""
        def square(bit: Column) -> Column:
            one, other = (F.call_function("shiftrightunsigned", half, bit).bitwiseAND(_long(255)) for half in (x, y))
            return F.pow(F.greatest(F.abs((one - other + STEPS).bitwiseAND(_long(255)) - STEPS) - 1, _long(0)), 2)

        return F.aggregate(F.array(*(F.lit(FIELD * at) for at in range(HALF))), F.lit(0.0), lambda s, bit: s + square(bit))

    return sure(a[0], b[0]) + sure(a[1], b[1]) <= STEPS * STEPS


def _spread(rows: DataFrame, axis: int, full: DataFrame | None) -> DataFrame:
    """Rows of full cells (of all, if None) in cells cut along further directions, each also in the next cell if that
    is within reach; ``_over`` has a bit for each direction along which a row stands in the next cell."""
    steps = [F.shiftrightunsigned(f"_q{at // HALF + 1}", FIELD * (at % HALF)).bitwiseAND(_long(255)) for at in range(axis, axis + CUT_AXES)]
    close = sum((F.when(s.bitwiseAND(_long(31)) >= 32 - STEPS, 1 << a).otherwise(0) for a, s in enumerate(steps)), F.lit(0))
    chosen = F.filter(F.array(*(F.lit(i) for i in range(1 << CUT_AXES))), lambda i: i.bitwiseAND(F.col("_close")) == i)
    if full is None:
        rows = rows.withColumn("_full", F.lit(True))
    else:
        rows = rows.join(full, "_cell", "left")
    rows = rows.withColumn("_close", close).withColumn("_up", F.explode(F.when(F.col("_full"), chosen).otherwise(F.array(F.lit(0)))))
    up = [F.shiftrightunsigned("_up", a).bitwiseAND(F.lit(1)) for a in range(CUT_AXES)]
    cut = F.xxhash64("_cell", *((F.shiftrightunsigned(s, 5) + u).bitwiseAND(_long(7)) for s, u in zip(steps, up, strict=True)))
    return rows.withColumn("_cell", F.when(F.col("_full"), cut).otherwise(F.col("_cell"))).withColumn(
        "_over", F.col("_over").bitwiseOR(F.shiftleft("_up", axis))).drop("_full", "_close", "_up")


def _shipped(rows: DataFrame, most: int = SHIPPED_CELLS) -> DataFrame:
    """A stored table, marked to be shipped if it is small: its estimated size says nothing."""
    return F.broadcast(rows) if fits(rows, most) else rows


def _tiled(left: DataFrame, right: DataFrame, sizes: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the tile of their cell (``_i``, ``_j``), so that none holds many more than ``rows`` rows of a side."""
    tiles = _shipped(checkpointed(sizes.where((F.col("_l") > rows) | (F.col("_r") > rows)).select(
        "_cell", *(F.ceil(F.col(n) / rows).cast("int").alias(to) for n, to in (("_l", "_rows"), ("_r", "_columns"))))))

    def placed(side: DataFrame, own: str, parts: str, other: str, others: str) -> DataFrame:
        mine, theirs = (F.coalesce(n, F.lit(1)) for n in (parts, others))
        return side.join(tiles, "_cell", "left").withColumn(own, F.pmod(F.xxhash64("_id"), mine).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), theirs - 1))).drop("_rows", "_columns")

    return placed(left, "_i", "_rows", "_j", "_columns"), placed(right, "_j", "_columns", "_i", "_rows")


def redundant_ids(vectors: DataFrame, threshold: float = 0.999, id_col: str = "chunk_id",
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """Ids whose vector has cosine above ``threshold`` with one of a smaller id.

    Vectors are moved only where they may have a partner. Unit vectors that close differ by at most one reach
    along any fixed direction, so each is told by its lengths along 14 directions, in two numbers. Exact copies
    are folded by a hash of 128 bits. Where many vectors agree in all directions, they are held against some of
    small id where they lie, which settles most. Sketches of the others meet in the cells of a grid; cells
    with many rows are cut along further directions, and a row goes into the next cell as well if that is within reach,
    which tells each pair of cells in one. No pairs are listed: the rows of a cell that any
    sketch admits fetch their vectors and are compared in tiles of bounded size; a semi-join stops at the first partner.
    """
    reach = math.sqrt(max(2.0 - 2.0 * threshold, 1e-12)) * (1 + 1e-9)
    # keys as one text, so that null keys are like others
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    raw = vectors.where(F.col(id_col).isNotNull() & F.col("embedding").isNotNull()).select(
        *keys, group.alias("_k"), F.xxhash64(group).alias("_kh"), F.col(id_col).alias("_id"), F.col("embedding").alias("_raw"))
    told = F.struct(*(_sketch(F.col("_v"), reach, half).alias(f"_q{half + 1}") for half in (0, 1)))

    def measured(rows: DataFrame) -> DataFrame:
        """Rows with unit vector and sketch, exploded from one, so that no filter or join repeats what makes them."""
        rows = rows.select(*(c for c in rows.columns if c != "_raw"), F.explode(F.array(l2_normalise(F.col("_raw")))).alias("_v"))
        return rows.select("*", F.explode(F.array(told)).alias("_told")).select("*", "_told.*").drop("_told")

    usable = F.col("_q1").isNotNull() & F.col("_q2").isNotNull()
    # a hash passes over nulls, so their places are part of it
    marks = F.when(~usable, F.transform("_v", lambda x: x.isNull()))
    unit = measured(raw)
    hashed = unit.select(*keys, "_kh", "_id", "_q1", "_q2", *(F.xxhash64(F.lit(seed), "_k", "_v", marks).alias(f"_h{seed}") for seed in (1, 2)))
    folded = checkpointed(hashed.groupBy(*keys, "_kh", "_h1", "_h2", "_q1", "_q2").agg(
        F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count("*").alias("_n")))
    copied = folded.where(F.col("_last") > F.col("_first"))
    # of two copies the last is known; more of them are found by their hash
    several = _shipped(checkpointed(copied.where("_n > 2").select("_h1", "_h2", "_first")))
    copies = copied.where("_n = 2").select(*keys, F.col("_last").alias("_id")).unionByName(
        hashed.select(*keys, "_id", "_h1", "_h2").join(several, ["_h1", "_h2"]).where(F.col("_id") > F.col("_first")).select(*keys, "_id"))
    folded = folded.where(usable).select("_kh", F.col("_first").alias("_id"), "_q1", "_q2")

    def sketches(side: str) -> tuple[Column, Column]:
        return F.col(f"{side}._q1"), F.col(f"{side}._q2")

    alike = ["_kh", "_a1", "_a2"]
    some = F.pmod(F.xxhash64("_id"), F.lit(PIVOTS)).alias("_some")
    open_, settled = folded, None
    # a second time with the borders between, for vectors that lie about a border
    for shift in (0, 16):
        cells = [(F.col(f"_q{half}") + _each(shift)).bitwiseAND(_each(0xE0)).alias(f"_a{half}") for half in (1, 2)]
        many = _shipped(checkpointed(folded.groupBy("_kh", *cells).agg(F.count("*").alias("_n")).where(
            F.col("_n") > ALIKE_ROWS).drop("_n")))
        picked = _shipped(checkpointed(folded.select("_kh", "_id", *cells).join(many, alike).groupBy(*alike, some).agg(
            F.min("_id").alias("_id")).select("_kh", "_id").distinct()))
        pivots = measured(raw.join(picked, ["_kh", "_id"])).where(usable).select("*", *cells)
        pivots = _shipped(checkpointed(pivots.groupBy(*alike, "_id").agg(F.min("_v").alias("_w"))), SHIPPED_PIVOTS)
        held = unit
        if settled is not None:
            rest = checkpointed(open_.select("_kh", "_id", *cells).join(many, alike).select("_kh", "_id").distinct())
            held = measured(raw.join(_shipped(rest, SHIPPED_ROWS), ["_kh", "_id"]))
        held = held.where(usable).select("*", *cells).join(many, alike).alias("l")
        near = checkpointed(held.join(pivots.alias("r"), [
            *(F.col(f"l.{c}") == F.col(f"r.{c}") for c in alike), F.col("r._id") < F.col("l._id"),
            dot(F.col("l._v"), F.col("r._w")) > threshold], "left_semi").select(*keys, "_kh", "_id"))
        open_ = checkpointed(open_.join(near.select("_kh", "_id"), ["_kh", "_id"], "left_anti"))
        settled = near if settled is None else settled.unionByName(near)

    def started(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_cell", F.col("_kh")).withColumn("_over", F.lit(0))

    left, right, full = started(open_), started(folded), None
    for axis in range(0, AXES - CUT_AXES + 1, CUT_AXES):
        left, right = _spread(left, axis, full), _spread(right, axis, full)
        full = checkpointed(left.groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > CUT_ROWS).select(
            "_cell", F.lit(True).alias("_full")))
        if full.isEmpty():
            break
        full = _shipped(full)
    sizes = checkpointed(left.groupBy("_cell").agg(F.count("*").alias("_l")).join(
        right.groupBy("_cell").agg(F.count("*").alias("_r")), "_cell"))
    a, b = _tiled(left, right.drop("_kh"), sizes, SKETCH_ROWS)
    met = a.alias("l").join(b.alias("r"), [
        *(F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("_cell", "_i", "_j")), F.col("r._id") < F.col("l._id"),
        F.col("l._over").bitwiseAND(F.col("r._over")) == 0, _may_be_near(sketches("l"), sketches("r"))])
    sides = F.array(*(F.struct(F.lit(s == "l").alias("_left"), F.col(f"{s}._id").alias("_id")) for s in ("l", "r")))
    # not in the join's condition, as a join whose condition loops over an array is not compiled
    sides = F.explode(F.when(_still_near(sketches("l"), sketches("r")), sides)).alias("_side")
    met = checkpointed(met.select(F.col("l._cell").alias("_cell"), F.col("l._kh").alias("_kh"), sides).select(
        "_cell", "_kh", "_side.*").distinct())
    sizes = checkpointed(met.groupBy("_cell").agg(F.count_if("_left").alias("_l"), F.count_if(~F.col("_left")).alias("_r")))
    fetched = raw.join(_shipped(met, SHIPPED_ROWS), ["_kh", "_id"])
    tile = ["_cell", "_k", "_i", "_j"]
    # moved as they came, and a repeated row compared once
    a, b = (measured(side.repartition(*tile).distinct()).where(usable) for side in _tiled(
        fetched.where("_left"), fetched.where(~F.col("_left")).drop(*keys), sizes, CELL_ROWS))
    close = a.alias("l").join(b.alias("r"), [
        *(F.col(f"l.{c}") == F.col(f"r.{c}") for c in tile), F.col("r._id") < F.col("l._id"),
        _may_be_near(sketches("l"), sketches("r")), _still_near(sketches("l"), sketches("r")),
        dot(F.col("l._v"), F.col("r._v")) > threshold], "left_semi")
    found = close.select(*keys, "_id").unionByName(settled.select(*keys, "_id")).unionByName(copies)
    return found.distinct().withColumnRenamed("_id", id_col)


def drop_redundant(vectors: DataFrame, threshold: float = 0.999, id_col: str = "chunk_id",
                   keys: tuple[str, ...] = ()) -> DataFrame:
    return vectors.join(redundant_ids(vectors, threshold, id_col, keys), [*keys, id_col], "left_anti")
