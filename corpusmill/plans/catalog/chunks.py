"""Chunks, sequences and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.functions.timecode import seconds_to_timecode
from corpusmill.operators import greedy, labels, ordered, splitting
from corpusmill.registry import query, table

UNITS_SQL = """
u AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS un FROM documents),
z AS (SELECT doc_id, un, list_transform(un, lambda x: CAST(ceil(length(x) / 4.0) AS BIGINT)) AS s, len(un) AS n FROM u)"""


def numbered_turns(spark, sf):
    """Turns numbered within their conversation; a long one is cut every 1024 turns."""
    return ordered.number_rows(table(spark, sf, "conversations"), ["conv_id"], ["turn"],
                               F.floor(F.col("turn") / 1024), "pos")


@query("explode_units", """
WITH u AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS un FROM documents)
SELECT doc_id, i - 1 AS pos, un[i] AS unit FROM (SELECT doc_id, un, unnest(range(1, len(un) + 1)) AS i FROM u)""")
def explode_units(spark, sf):
    return splitting.explode_units(table(spark, sf, "documents").select("doc_id", "text"))


@query("chunk_pack", "WITH RECURSIVE " + UNITS_SQL + """,
p AS (SELECT doc_id, un, n, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(s[1:i]), 0)::BIGINT) AS t FROM z),
c AS (
  SELECT doc_id, un, n, t, 0 AS no, 0::BIGINT AS a,
    coalesce(list_filter(range(1, n), lambda e: t[e + 2] > t[1] + 256)[1], n) AS b FROM p WHERE n > 0
  UNION ALL
  SELECT doc_id, un, n, t, no + 1, a2, coalesce(list_filter(range(b + 1, n), lambda e: t[e + 2] > t[a2 + 1] + 256)[1], n)
  FROM (SELECT *, greatest(a, list_filter(range(0, b + 1), lambda j: t[b + 1] - t[j + 1] <= 32)[1]) AS a2 FROM c WHERE b < n))
SELECT doc_id, no AS chunk_no, count(*) OVER (PARTITION BY doc_id) AS n_chunks, array_to_string(un[a + 1:b], ' ') AS page_content FROM c""")
def chunk_pack(spark, sf):
    return splitting.pack(table(spark, sf, "documents").select("doc_id", "text"), 256, 32)


@query("chunk_number", """
SELECT conv_id, turn, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_chunks,
  CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN '' WHEN row_number() OVER w = 1 THEN '- Chunk 1/' || count(*) OVER (PARTITION BY conv_id)
    ELSE '- ---' || chr(10) || '- Chunk ' || row_number() OVER w || '/' || count(*) OVER (PARTITION BY conv_id) END AS header
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chunk_number(spark, sf):
    sizes = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    turns = numbered_turns(spark, sf).join(sizes, "conv_id")
    mark = F.concat(F.lit("- Chunk "), "pos", F.lit("/"), "n_chunks")
    header = F.when(F.col("n_chunks") == 1, "").when(F.col("pos") == 1, mark).otherwise(F.concat(F.lit("- ---\n"), mark))
    return turns.select("conv_id", "turn", "pos", "n_chunks", header.alias("header"))


@query("prev_context", """
WITH l AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_filter(string_split(before, chr(10)), lambda x: regexp_matches(x, '[^-\\s]'))[-10:], chr(10)), '') AS context FROM l
""")
def prev_context(spark, sf):
    turns = numbered_turns(spark, sf).select("conv_id", "turn", "pos", "text")
    linked = ordered.with_previous(turns, ["conv_id"], "pos", "text", "before")
    lines = F.filter(F.split("before", "\n"), lambda li: li.rlike(r"[^-\s]"))
    tail = F.slice(lines, F.greatest(F.size(lines) - 9, F.lit(1)), F.lit(10))
    return linked.select("conv_id", "turn", F.coalesce(F.array_join(tail, "\n"), F.lit("")).alias("context"))


@query("page_fold", """
SELECT conv_id, turn // 3 AS page, string_agg(text, chr(10) ORDER BY turn) AS page_content,
  CASE WHEN count(DISTINCT role) = 1 THEN min(role) ELSE array_to_string(list_distinct_in_order, ',') END AS roles FROM (
  SELECT *, list_transform(list_filter(rs, lambda x, i: list_position(rs, x) = i), lambda x: x) AS list_distinct_in_order FROM (
    SELECT *, list(role) OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rs FROM conversations))
GROUP BY conv_id, turn // 3, list_distinct_in_order""")
def page_fold(spark, sf):
    nodes = table(spark, sf, "conversations").withColumn("page", F.floor(F.col("turn") / 3))
    folded = splitting.fold_pages(nodes, ["conv_id", "page"], "turn", "text", "role")
    return folded.select("conv_id", "page", "page_content", F.array_join("role", ",").alias("roles"))


@query("embed_batches", """
WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER w AS i, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER w AS t FROM documents WINDOW w AS (ORDER BY doc_id)),
n AS (SELECT a.i, any_value(a.doc_id) AS doc_id, coalesce(min(b.i), max(a.i) + 100) AS next FROM (SELECT *, coalesce(lag(t) OVER (ORDER BY i), 0) AS before FROM p) a
  LEFT JOIN p b ON b.i > a.i AND (b.t - a.before > 20000 OR b.i - a.i >= 100) AND b.i - a.i <= 100 GROUP BY a.i),
c AS (SELECT i, next, 0 AS batch FROM n WHERE i = 1 UNION ALL SELECT n.i, n.next, batch + 1 FROM c JOIN n ON n.i = c.next)
SELECT batch::BIGINT AS batch, doc_id FROM c JOIN n ON n.i >= c.i AND n.i < c.next""")
def embed_batches(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.est_tokens(F.col("text")).alias("tkn_length"))
    return greedy.embedding_batches(docs, max_tokens=20_000, max_docs=100).select("batch", "doc_id")


@query("segment_rebase", """
WITH b AS (SELECT event_id, user_id, value::DECIMAL(18, 2) AS d, coalesce(sum(value::DECIMAL(18, 2)) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events),
f AS (SELECT event_id, user_id, s::DOUBLE AS start, (s + d)::DOUBLE AS stop, CAST(floor(s) AS BIGINT) AS w FROM b)
SELECT event_id, user_id, start, stop, printf('%02d:%02d:%02d', w // 3600, w % 3600 // 60, w % 60) AS code FROM f""")
def segment_rebase(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("value").cast("decimal(18,2)").alias("d"))
    moved = ordered.running_total(events, ["user_id"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")),
                                  F.col("d"), "start", include_self=False)
    return moved.select("event_id", "user_id", F.col("start").cast("double").alias("start"),
                        (F.col("start") + F.col("d")).cast("double").alias("stop"),
                        seconds_to_timecode(F.col("start")).alias("code"))


@query("unique_suffix", r"""
WITH p AS (SELECT DISTINCT url AS path, list_filter(string_split(url, '/'), lambda x: x <> '') AS parts FROM pages),
l AS (SELECT path, d, array_to_string(parts[-d:], '/') AS label FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS d FROM p)),
u AS (SELECT path, d, label FROM l WHERE (SELECT count(*) FROM p o WHERE ends_with(o.path, l.label)) = 1)
SELECT p.path, coalesce(arg_min(u.label, u.d), p.path) AS label FROM p LEFT JOIN u ON p.path = u.path GROUP BY p.path""")
def unique_suffix(spark, sf):
    return labels.shortest_suffixes(table(spark, sf, "pages").select(F.col("url").alias("path")))
