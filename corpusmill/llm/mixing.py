"""Mixing sources to target weights, as a flow from documents to source quotas.

Documents are aggregated by the set of sources they belong to; the flow network
has one node per such pattern and one per source, however many documents there
are. A pattern offers its words once per repetition, each repetition dearer than
the one before, so the cheapest flow repeats as evenly as the quotas allow. The
words routed from a pattern are then handed to its documents: whole repetitions
for all of them, the rest to documents in a seeded order.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.stores import fresh, stored

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4096
SMALL_PLAN = 100_000


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quotas(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """``total`` shared by weight; no share above ``most`` times its size, the excess reshared."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        sum_w = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / sum_w > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / sum_w
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def route(patterns: Sequence[tuple[Sequence[int], int]], wanted: Sequence[int], repeats: int) -> list[list[int]]:
    """Minimum-cost flow: words of each pattern sent to each of its sources.

    ``patterns``: (source numbers, words). Pattern ``p`` has ``repeats`` arcs of its
    words each, the k-th at cost k; a source takes at most what it wants. The most
    that can be sent is sent, at the least sum of costs, by shortest augmenting
    paths on levels of repetition: as costs are small integers, all paths of one
    cost are found by breadth-first searches before the next.
    """
    flow = [[0] * len(s) for s, _ in patterns]
    sent, got = [0] * len(patterns), [0] * len(wanted)
    into = defaultdict(list)
    for p, (sources, _) in enumerate(patterns):
        for k, s in enumerate(sources):
            into[s].append((p, k))
    for level in range(1, repeats + 1):
        while True:
            # from patterns with words left on this level, over arcs and back over flow, to an open source
            parent_s: dict[int, tuple[int, int]] = {}
            parent_p: dict[int, tuple[int, int] | None] = {
                p: None for p, (_, words) in enumerate(patterns) if sent[p] < level * words}
            queue, goal = deque(parent_p), None
            while queue and goal is None:
                p = queue.popleft()
                for k, s in enumerate(patterns[p][0]):
                    if s in parent_s:
                        continue
                    parent_s[s] = (p, k)
                    if got[s] < wanted[s]:
                        goal = s
                        break
                    for other, at in into[s]:
                        if flow[other][at] and other not in parent_p:
                            parent_p[other] = (s, at)
                            queue.append(other)
            if goal is None:
                break
            path, room, s = [], wanted[goal] - got[goal], goal
            while True:
                p, k = parent_s[s]
                path.append((p, k, 1))
                back = parent_p[p]
                if back is None:
                    room = min(room, level * patterns[p][1] - sent[p])
                    break
                room = min(room, flow[p][back[1]])
                path.append((p, back[1], -1))
                s = back[0]
            for p, k, sign in path:
                flow[p][k] += sign * room
            sent[path[-1][0]] += room
            got[goal] += room
    return flow


def mix(docs: DataFrame, sources: Column | None = None, size: Column | None = None,
        cycle: Sequence[float] = (5, 2, 1), share: float = 1.0, repeats: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` with what the mix takes of each: ``mix_size``, ``mix_source_size``, ``mix_target``,
    ``mix_taken`` (words, repetitions counted), ``mix_repeats`` and ``mix_rest`` (words of one more,
    partial repetition).

    ``sources``: an array of source names per document (default: the column
    ``source`` alone); ``size``: default, the words of ``text``. Sources in order of
    code points, null last, weigh ``cycle``, repeated; they share ``share`` of all
    sizes, none above ``repeats`` times its own size. A document of several sources
    counts in the size of each; its ``mix_source_size`` and ``mix_target`` are those
    of its first source. An empty or null array is the null source.

    Where no document has several sources, a pattern is a source and takes its quota:
    numbers and quotas are DataFrame aggregates over the table of sources, however many.
    Else the table of patterns (source set, words, documents) is brought to the driver for
    the flow. Documents of size 0 take nothing. Rows are ordered by a hash of id, text and
    ``seed``, and a rerun takes the same. No documents give no rows. The new columns
    replace columns of those names.
    """
    new = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_repeats", "mix_rest")
    own = docs.drop(*new)
    inner = fresh(own, "pattern", "rank", "bucket", "whole", "buckets", "cut_bucket", "cut_rank", "each", "left")
    pattern, rank, bucket, whole, buckets, cut_bucket, cut_rank, each, left = inner
    names = F.array(F.col("source")) if sources is None else sources
    names = F.coalesce(names, F.array(F.lit(None).cast("string")))
    names = F.when(F.size(names) == 0, F.array(F.lit(None).cast("string"))).otherwise(names)
    sized = own.withColumns({
        pattern: F.sort_array(F.array_distinct(names)),
        "mix_size": (word_count(F.col("text")) if size is None else size).cast("bigint"),
        rank: F.xxhash64(F.col("doc_id"), "text", F.lit(seed))})
    # three numbers a document; the texts are read again for the result, and never moved
    narrow = stored(sized.select(F.col(pattern).alias("pattern"), F.col("mix_size").alias("size"), F.col(rank).alias("rank")), "sizes")
    groups = stored(narrow.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "patterns")
    several = groups.where(F.size("pattern") > 1)
    routed = (_quota_plan if several.isEmpty() else _flow_plan)(groups, cycle, share, repeats)
    has = F.col("words") > 0
    plan = stored(_cuts(narrow, stored(routed.select(
        "pattern", "mix_source_size", "mix_target",
        F.when(has, F.floor(F.col("sent") / F.col("words"))).otherwise(0).cast("bigint").alias("whole"),
        F.when(has, F.col("sent") % F.col("words")).otherwise(0).alias("rest"),
        F.ceil(F.col("rows") / BUCKET_ROWS).cast("bigint").alias("buckets")), "routed")), "plan")
    names_of = {"pattern": pattern, "whole": whole, "buckets": buckets, "cut_bucket": cut_bucket, "cut_rank": cut_rank, "each": each}
    table = _small(plan.select(*(F.col(c).alias(names_of.get(c, c)) for c in plan.columns)))
    data = sized.join(table, pattern).withColumn(bucket, _bucket(F.col(rank), F.col(buckets)))
    before, here = F.col(bucket) < F.col(cut_bucket), F.col(bucket) == F.col(cut_bucket)
    data = data.withColumn(left, F.when(before | (here & (F.col(rank) < F.col(cut_rank))), F.col("mix_size")).when(
        here & (F.col(rank) == F.col(cut_rank)), F.least(F.col(each), F.col("mix_size"))).otherwise(0))
    all_of_it = F.col(left) == F.col("mix_size")
    return data.withColumns({
        "mix_repeats": F.col(whole) + F.when(all_of_it & (F.col("mix_size") > 0), 1).otherwise(0),
        "mix_rest": F.when(all_of_it, F.lit(0)).otherwise(F.col(left)).cast("bigint"),
        "mix_taken": F.col(whole) * F.col("mix_size") + F.col(left)}).select(*own.columns, *new)


def _small(table: DataFrame) -> DataFrame:
    """A table of patterns for joins: shipped below a bound of rows of some 100 bytes, else dealt by pattern."""
    return F.broadcast(table) if table.count() <= SMALL_PLAN else table


def _bucket(rank: Column, buckets: Column) -> Column:
    """The bucket of a rank: buckets follow each other in no order but the ranks' own hash."""
    return F.floor(F.pmod(rank, F.lit(1 << 40)) / (1 << 40) * buckets)


def _cuts(narrow: DataFrame, routed: DataFrame) -> DataFrame:
    """``routed`` with where the rest of each pattern ends: its bucket, the rank there, and the words each row of that rank takes.

    Documents take their rest in order of bucket and rank. Buckets are totalled first, so only the
    one in which the rest ends is ordered. Rows of equal rank, as repeated rows are, share alike.
    """
    placed = narrow.join(_small(routed.where("rest > 0").select("pattern", "rest", "buckets")), "pattern").withColumn(
        "bucket", _bucket(F.col("rank"), F.col("buckets")))
    along = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("total")).withColumn(
        "base", F.coalesce(F.sum("total").over(along), F.lit(0)))
    ends = stored(totals.where((F.col("base") < F.col("rest")) & (F.col("rest") <= F.col("base") + F.col("total"))).select(
        "pattern", F.col("bucket").alias("cut_bucket"), (F.col("rest") - F.col("base")).alias("need")), "ends")
    rows = placed.join(_small(ends), "pattern").where(F.col("bucket") == F.col("cut_bucket"))
    tied = rows.groupBy("pattern", "rank", "need").agg(F.sum("size").alias("total"), F.count("*").alias("many"))
    by_rank = Window.partitionBy("pattern").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    cut = tied.withColumn("base", F.coalesce(F.sum("total").over(by_rank), F.lit(0))).where(
        (F.col("base") < F.col("need")) & (F.col("need") <= F.col("base") + F.col("total"))).select(
            "pattern", F.col("rank").alias("cut_rank"), F.floor((F.col("need") - F.col("base")) / F.col("many")).cast("bigint").alias("each"))
    return routed.drop("rest").join(ends.drop("need"), "pattern", "left").join(cut, "pattern", "left")


def _quota_plan(groups: DataFrame, cycle: Sequence[float], share: float, repeats: int) -> DataFrame:
    """``groups`` of one source each with ``mix_source_size``, ``mix_target`` and ``sent``."""
    source = F.col("pattern")[0]
    # numbered along the code points, null last: by ranges first, then inside them
    ordered = stored(groups.repartitionByRange(source.asc_nulls_last()).sortWithinPartitions(source.asc_nulls_last())
                     .withColumn("at", F.monotonically_increasing_id()), "sources")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a task
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    table = stored(ordered.withColumn("part", part).join(F.broadcast(before), "part").withColumn(
        "slot", ((F.col("before") + inside) % len(cycle)).cast("int")).withColumn("weight", F.get(weights, F.col("slot"))), "weights")
    most = F.lit(float(repeats)) * F.col("words")
    total = share * (table.agg(F.sum("words")).first()[0] or 0)
    level, known = 0.0, -1
    while True:  # the words a unit of weight gets rises until no further source is full
        full = most < F.lit(level) * F.col("weight")
        # whole numbers, so that the order of summing is no matter
        state = table.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("words"))).alias("words"), *(
            F.count(F.when(~full & (F.col("slot") == i), 1)).alias(f"open{i}") for i in range(len(cycle)))).first()
        open_weight = sum(w * state[f"open{i}"] for i, w in enumerate(cycle))
        if state["n"] == known or not open_weight:
            break
        known, level = state["n"], (total - repeats * (state["words"] or 0)) / open_weight
    target = F.least(most, F.lit(level) * F.col("weight"))
    return table.select("pattern", "words", "rows", F.col("words").alias("mix_source_size"), target.alias("mix_target"),
                        F.least(F.round(target), most).cast("bigint").alias("sent"))


def _flow_plan(groups: DataFrame, cycle: Sequence[float], share: float, repeats: int) -> DataFrame:
    """``groups`` with ``mix_source_size``, ``mix_target`` and ``sent``, by the flow on the driver."""
    rows = sorted(groups.collect(), key=lambda g: [(s is None, s or "") for s in g["pattern"]])
    known = sorted({s for g in rows for s in g["pattern"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(known)}
    patterns = [([number[s] for s in g["pattern"]], g["words"]) for g in rows]
    sizes = [0] * len(known)
    for members, words in patterns:
        for s in members:
            sizes[s] += words
    weights = [cycle[i % len(cycle)] for i in range(len(known))]
    targets = quotas(sizes, weights, share * sum(w for _, w in patterns), repeats)
    flow = route(patterns, [round(t) for t in targets], repeats)
    plan = [(list(g["pattern"]), words, g["rows"], sizes[min(members)], targets[min(members)], sum(sent))
            for (members, words), sent, g in zip(patterns, flow, rows, strict=True)]
    return groups.sparkSession.createDataFrame(
        plan, "pattern array<string>, words bigint, rows bigint, mix_source_size bigint, mix_target double, sent bigint")
