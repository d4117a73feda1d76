"""Sharding by balanced label propagation, with DataFrame operations only.

Documents that share a text are linked through their group. In each round every
group counts its members per shard; members move to the shard where most of their
group is, as far as members of other groups come the other way or the shard has room.
Rounds go on while the cut falls. Groups that are still cut, among them those larger than a
shard, are then laid along the room that the others leave. At last rows beyond a shard's exact
count, documents without links first, fill the shards below theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.stores import stored
from corpusmill.operators.ordered import running_total

BUCKET_ROWS = 4096
SPACE = 1 << 40
STATE = ["row_id", "link", "n", "mark", "shard"]


def _numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Rows numbered from 0 within ``keys``; the order is cut into buckets, sorted apart."""
    return running_total(df, keys, order, bucket, F.lit(1).cast("bigint"), name, include_self=False)


def _bucket(mark: Column, rows: int) -> Column:
    """A bucket along ``mark`` (a hash), of about ``BUCKET_ROWS`` of ``rows`` rows."""
    return F.floor(F.pmod(mark, F.lit(SPACE)) / SPACE * max(1, -(-rows // BUCKET_ROWS)))


def _wishes(state: DataFrame, most: int, turn: int) -> DataFrame:
    """Parts of groups (link, shard, here) that wish to move ``to`` the shard of their group's largest; stored.

    A hash decides between parts of equal counts, another one in each turn. Groups of
    more than ``most`` rows fit no shard and wish nothing.
    """
    linked = state.where(F.col("link").isNotNull() & (F.col("n") <= most))
    tie = F.xxhash64("link", "shard", F.lit(turn))
    held = linked.groupBy("link", "shard").agg(F.count("*").alias("here")).withColumn("tie", tie)
    best = held.groupBy("link").agg(F.max(F.struct("here", "tie", "shard")).alias("best"))
    return stored(held.join(best, "link").where(F.col("shard") != F.col("best.shard")).select(
        "link", "shard", F.col("best.shard").alias("to"), "here", F.col("best.here").alias("gain"), "tie"), "moves")


def _quotas(state: DataFrame, moves: DataFrame, most: int, shards: int) -> DataFrame:
    """Rows that may go from ``shard`` ``to`` another: as many as wish to come back, and a part of the room there."""
    names = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("to"))
    # rows without links can go anywhere, so only linked rows count against a shard's even part
    sizes = state.where(F.col("link").isNotNull()).groupBy(F.col("shard").alias("to")).agg(F.count("*").alias("size"))
    room = names.join(sizes, "to", "left").select(
        "to", F.greatest(F.lit(0), F.lit(most) - F.coalesce("size", F.lit(0))).alias("room"))
    # one row per pair of shards
    there = moves.groupBy("shard", "to").agg(F.sum("here").alias("there"))
    back = there.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("there").alias("back"))
    pairs = there.join(back, ["shard", "to"], "left").join(room, "to")
    swap = F.least("there", F.coalesce("back", F.lit(0)))
    left = pairs.withColumns({"swap": swap, "more": F.col("there") - swap})
    all_ = Window.partitionBy("to")
    upto = all_.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = left.withColumns({"sum": F.sum("more").over(all_), "upto": F.sum("more").over(upto)})
    given = F.least("room", "sum")
    share = F.expr("CASE WHEN sum > 0 THEN (given * upto) DIV sum - (given * (upto - more)) DIV sum ELSE 0 END")
    return left.withColumn("given", given).select("shard", "to", (F.col("swap") + share).alias("quota"))


def _round(state: DataFrame, moves: DataFrame, many: int, rows: int, shards: int) -> DataFrame:
    """One round of propagation over ``STATE``: the ``many`` wishes granted as far as the quotas go."""
    # levels of gain by powers of two, largest first; within a level a hash, cut into buckets
    buckets = max(1, -(-many // BUCKET_ROWS))
    marked = moves.withColumn("_mark", F.pmod("tie", F.lit(SPACE)))
    level = 63 - F.floor(F.log2(F.col("gain").cast("double")))
    place = (level * buckets + F.floor(F.col("_mark") / SPACE * buckets)).cast("bigint")
    ranked = running_total(marked, ["shard", "to"], ["_mark", "link"], place, F.col("here"), "ahead", include_self=False)
    ranked = ranked.join(F.broadcast(_quotas(state, moves, rows // shards, shards)), ["shard", "to"])
    take = F.greatest(F.lit(0), F.least("here", F.col("quota") - F.col("ahead")))
    allowed = ranked.withColumn("take", take).where("take > 0").select("link", "shard", "to", "take", "here")
    joined = state.join(allowed, ["link", "shard"], "left")
    split = F.coalesce(F.col("take") < F.col("here"), F.lit(False))
    whole = joined.where(~split).withColumn("shard", F.coalesce("to", "shard")).select(STATE)
    # of a part too large for the quota, the first along the marks move
    part = _numbered(joined.where(split), ["link", "shard"], ["mark", "row_id"], _bucket(F.col("mark"), rows), "at")
    part = part.withColumn("shard", F.when(F.col("at") < F.col("take"), F.col("to")).otherwise(F.col("shard")))
    return whole.unionByName(part.select(STATE))


def fill(groups: list[tuple[object, int]], rooms: dict[int, int]) -> list[tuple[object, int, int, int]]:
    """Pieces (group, first row, end, shard) that put groups, largest first, into the least room that holds them.

    A group that no room holds takes the largest ones until one holds the rest. The rooms
    must be enough for all.
    """
    rooms, out = dict(rooms), []
    for name, n in sorted(groups, key=lambda g: -g[1]):
        at = 0
        while at < n:
            fits = [(room, s) for s, room in rooms.items() if room >= n - at]
            room, s = min(fits) if fits else max((room, -s) for s, room in rooms.items())
            s, step = (s, n - at) if fits else (-s, room)
            out.append((name, at, at + step, s))
            rooms[s] -= step
            at += step
    return out


def _packed(state: DataFrame, rows: int, shards: int) -> DataFrame:
    """``state`` with the groups that are cut, or beyond a shard's count, laid along the room of the shards.

    Of those, at most one per shard meets the end of a room; these are placed last, into
    what room is left, and only they can stay cut.
    """
    spark = state.sparkSession
    linked = state.where(F.col("link").isNotNull())
    groups = stored(linked.groupBy("link").agg(F.count("*").alias("n"), F.min("shard").alias("low"),
                                               F.max("shard").alias("high")), "homes")
    many = groups.count()
    if not many:
        return state
    hashed = F.pmod(F.xxhash64("link"), F.lit(SPACE))
    along = F.floor(hashed / SPACE * max(1, -(-many // BUCKET_ROWS))).cast("bigint")
    whole = groups.where("low = high").select("link", "n", F.col("low").alias("shard"))
    ranked = running_total(whole, ["shard"], ["link"], along, F.col("n"), "upto")
    # one row per shard; where rows do not divide evenly, the fullest shards hold one more
    held = {r["shard"]: r["size"] for r in whole.groupBy("shard").agg(F.sum("n").alias("size")).collect()}
    fullest = sorted(range(shards), key=lambda s: (-held.get(s, 0), s))
    cap = {s: rows // shards + (k < rows % shards) for k, s in enumerate(fullest)}
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in cap.items() for x in pair)), F.col("shard"))
    ranked = stored(ranked.withColumn("stays", F.col("upto") <= limit), "homes")
    room = dict(cap)
    for r in ranked.where("stays").groupBy("shard").agg(F.sum("n").alias("size")).collect():
        room[r["shard"]] -= r["size"]
    loose = stored(groups.where("low <> high").select("link", "n").unionByName(
        ranked.where("NOT stays").select("link", "n")), "loose")
    count = loose.count()
    if not count:
        return state
    line, at = [], 0
    for s in sorted(room, key=lambda s: (-room[s], s)):
        if room[s]:
            line.append(F.struct(F.lit(s).alias("home"), F.lit(at).cast("bigint").alias("from"),
                                 F.lit(at + room[s]).cast("bigint").alias("end")))
            at += room[s]
    line = spark.range(1).select(F.explode(F.array(*line)).alias("l")).select("l.*")
    buckets = max(1, -(-count // BUCKET_ROWS))
    level = 63 - F.floor(F.log2(F.col("n").cast("double")))
    place = (level * buckets + F.floor(hashed / SPACE * buckets)).cast("bigint")
    laid = running_total(loose, [], ["link"], place, F.col("n"), "at", include_self=False)
    inside = (F.col("at") >= F.col("from")) & (F.col("at") < F.col("end"))
    laid = stored(laid.join(F.broadcast(line), inside).select(
        "link", "n", "home", (F.col("at") + F.col("n") > F.col("end")).alias("meets")), "laid")
    for r in laid.where("NOT meets").groupBy("home").agg(F.sum("n").alias("size")).collect():
        room[r["home"]] -= r["size"]
    ends = [(r["link"], r["n"]) for r in laid.where("meets").select("link", "n").collect()]  # one per shard at most
    goal = laid.select("link", "meets", "home")
    joined = linked.join(goal, "link", "left")
    out = state.where(F.col("link").isNull()).select(STATE).unionByName(
        joined.where(~F.coalesce("meets", F.lit(False))).withColumn("shard", F.coalesce("home", "shard")).select(STATE))
    if not ends:
        return out
    pieces = [F.struct(F.lit(link).alias("link"), F.lit(a).cast("bigint").alias("first"), F.lit(b).cast("bigint").alias("end"),
                       F.lit(s).alias("into")) for link, a, b, s in fill(ends, room)]
    pieces = spark.range(1).select(F.explode(F.array(*pieces)).alias("p")).select("p.*")
    rest = linked.join(F.broadcast(pieces.select("link").distinct()), "link", "left_semi")
    rest = _numbered(rest, ["link"], ["mark", "row_id"], _bucket(F.col("mark"), rows), "at").join(
        F.broadcast(pieces), "link").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("end")))
    return out.unionByName(rest.withColumn("shard", F.col("into")).select(STATE))


def _even(state: DataFrame, rows: int, shards: int) -> DataFrame:
    """Exact counts: the last rows of full shards fill the others; then slots."""
    names = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    # one row per shard
    sizes = names.join(state.groupBy("shard").agg(F.count("*").alias("size"), F.count("link").alias("linked")),
                       "shard", "left").fillna(0, ["size", "linked"])
    # where rows do not divide evenly, the shards with most linked rows hold one more
    order = Window.orderBy(F.desc("linked"), F.desc("size"), "shard")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    due = F.lit(rows // shards) + F.when(F.row_number().over(order) <= rows % shards, 1).otherwise(0)
    counted = sizes.withColumn("due", due).withColumns({
        "over": F.greatest(F.lit(0), F.col("size") - F.col("due")),
        "under": F.greatest(F.lit(0), F.col("due") - F.col("size"))})
    plan = counted.withColumns({"over_before": F.coalesce(F.sum("over").over(before), F.lit(0)),
                                "under_before": F.coalesce(F.sum("under").over(before), F.lit(0))})
    # linked rows come first in a shard, group by group, so that rows without links leave first; a
    # group of many rows has places of its own, along the marks
    along = _bucket(F.col("mark"), rows)
    hashed = F.pmod(F.xxhash64("link"), F.lit(SPACE))
    place = (F.when(F.col("link").isNull(), F.lit(1 << 62) + along)
             .when(F.col("n") > BUCKET_ROWS, F.lit(1 << 61) + F.pmod(hashed, F.lit(1 << 20)) * (1 << 30) + along)
             .otherwise(_bucket(hashed, rows)).cast("bigint"))
    placed = _numbered(state.withColumn("place", place), ["shard"], ["place", "link", "mark", "row_id"],
                       F.col("place"), "at")
    placed = placed.join(F.broadcast(plan.select("shard", "due", "over_before")), "shard")
    stays = placed.where(F.col("at") < F.col("due")).select("row_id", "shard", F.col("at").alias("slot"))
    # the n-th row that leaves goes to the shard whose gap holds the n-th free place
    going = placed.where(F.col("at") >= F.col("due")).select(
        "row_id", (F.col("over_before") + F.col("at") - F.col("due")).alias("nth"))
    gaps = plan.where(F.col("under") > 0).select("shard", "size", "under_before", "under")
    inside = (F.col("nth") >= F.col("under_before")) & (F.col("nth") < F.col("under_before") + F.col("under"))
    came = going.join(F.broadcast(gaps), inside).select(
        "row_id", "shard", (F.col("size") + F.col("nth") - F.col("under_before")).alias("slot"))
    return stays.unionByName(came)


def shard(docs: DataFrame, shards: int = 40, seed: int = 23) -> DataFrame:
    """Put ``docs`` into ``shards`` shards; one row per document.

    Columns: ``doc_id``, ``size`` (bytes of the text plus 16), ``text_crc32``, ``law``
    (``rows``: the counts of any two shards differ by one at most), ``shard``, ``slot``
    (the place in the shard, gapless from 0), ``grown_shard`` (null under this law).

    Equal texts are linked. A group stays in one shard unless it is larger than a
    shard's even part, or than what is left of any; then it fills as few shards as their
    room allows. At most one group per shard is cut.
    Null texts have size 16, a null checksum and no links; empty texts are one
    group. Rows of equal or null ids are placed one by one like any other. No
    documents give no rows. Columns other than ``doc_id`` and ``text`` are not read.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    # the text is read once; all that follows works on narrow rows
    text_key = F.when(F.col("text").isNotNull(), F.struct(
        F.xxhash64("text").alias("short"), F.md5(F.col("text").cast("binary")).alias("long")))
    narrow = stored(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), text_key.alias("key"),
        F.monotonically_increasing_id().alias("row_id")), "narrow")
    rows = narrow.count()
    groups = narrow.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # stored, so that the join deals its sides anew and can split a text of very many copies
    links = stored(groups.select("key", F.col("key.long").alias("link"), "n"), "groups")
    mark = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(SPACE))
    state = narrow.join(links, "key", "left").select(
        "row_id", "link", "n", mark.alias("mark"), F.pmod(mark, F.lit(shards)).cast("int").alias("shard"))
    state = stored(state, "shards")
    cut, turn = None, 0
    while True:
        moves = _wishes(state, rows // shards, turn)
        many = moves.count()  # the parts in which groups are cut
        # once rounds bring less than a tenth, what is left is laid out without them
        if not many or (cut is not None and 10 * many > 9 * cut):
            break
        state = stored(_round(state, moves, many, rows, shards), "shards")
        cut, turn = many, turn + 1
    placed = _even(stored(_packed(state, rows, shards), "shards"), rows, shards)
    return narrow.join(placed, "row_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
