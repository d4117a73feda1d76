"""Parse and summary tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import models
from corpusmill.operators.documents import metadata_map
from corpusmill.plans import summarize as Z
from corpusmill.plans.catalog.chunks import UNITS_SQL, numbered_turns
from corpusmill.registry import query, table
from corpusmill.sinks import formats
from corpusmill.sinks.outline import link_tags

NUMBERED_SQL = """
t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


def parsed(spark, sf, fmt):
    """Each conversation as one document, its turns as the chunks."""
    sizes = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    turns = numbered_turns(spark, sf).join(sizes, "conv_id")
    chunks = turns.select("conv_id", "pos", "n_chunks", F.col("text").alias("page_content"),
                          metadata_map({"role": F.col("role")}).alias("metadata"))
    return formats.pieces(chunks, fmt)


@query("parse_text", "WITH " + NUMBERED_SQL + r"""
SELECT conv_id, pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS piece FROM t""")
def parse_text(spark, sf):
    return parsed(spark, sf, "text")


@query("parse_split_text", "WITH " + NUMBERED_SQL + r"""
SELECT conv_id, pos, CASE WHEN n = 1 THEN 'Parsed document:' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE
  CASE WHEN pos = 1 THEN 'Parsed documents:' || chr(10) ELSE '' END || 'Doc #' || pos || '/' || n || chr(10) ||
  CASE WHEN pos = n THEN regexp_replace(text, '\s+$', '') ELSE text || chr(10) || chr(10) END END AS piece FROM t""")
def parse_split_text(spark, sf):
    return parsed(spark, sf, "split_text")


@query("parse_xml", "WITH " + NUMBERED_SQL + """
SELECT conv_id, pos, CASE WHEN pos = 1 THEN '<documents>' || chr(10) ELSE '' END || '<doc id=' || (pos - 1) || '>' || chr(10) || text || chr(10) || '</doc>'
  || CASE WHEN pos = n THEN chr(10) || '</documents>' ELSE '' END AS piece FROM t""")
def parse_xml(spark, sf):
    return parsed(spark, sf, "xml")


@query("parse_dict", "WITH " + NUMBERED_SQL + """
SELECT conv_id, pos, '{"page_content":' || to_json(text)::VARCHAR || ',"metadata":{"role":"' || role || '"}}' AS piece FROM t""")
def parse_dict(spark, sf):
    return parsed(spark, sf, "dict")


@query("summary_header", """
SELECT doc_id, '<text_metadata>' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '<title>' || chr(10) || source || chr(10) || '</title>' || chr(10) ELSE '' END ||
  '<reading_length>' || chr(10) || printf('%.1f', round(CAST(round(length(text) / 6 / 250, 3) AS DECIMAL(18, 3)), 1)::DOUBLE) || ' minutes' || chr(10) || '</reading_length>' || chr(10) ||
  '<author>' || chr(10) || lang || chr(10) || '</author>' || chr(10) || '<today>' || chr(10) || '2024-01-31' || chr(10) || '</today>' || chr(10) ||
  '<section_number>' || chr(10) || '1/1' || chr(10) || '</section_number>' || chr(10) || '</text_metadata>' AS header FROM documents""")
def summary_header(spark, sf):
    header = Z.metadata_header(F.col("source"), text.doc_reading_time(F.col("text")), F.col("lang"), F.lit(None).cast("string"),
                               F.lit("2024-01-31"), F.lit("1/1"), F.pmod("doc_id", F.lit(2)) == 1)
    return table(spark, sf, "documents").select("doc_id", header.alias("header"))


# chunks of 1024 tokens with 500 of overlap; a chunk's bullets leave out what the last ten lines before it said
CLOSE_SQL = """list_transform(list_transform(list_filter(list_transform({0}, lambda x: replace(x, '****', '')), lambda x: regexp_matches(x, '\\p{{L}}')),
  lambda x: x || CASE WHEN (length(x) - length(replace(x, '**', ''))) / 2 % 2 = 1 THEN '**' ELSE '' END),
  lambda x: x || CASE WHEN (length(x) - length(replace(x, '*', ''))) % 2 = 1 THEN '*' ELSE '' END)"""
SUMMARY_SQL = "WITH RECURSIVE " + UNITS_SQL + r""",
p AS (SELECT doc_id, un, n, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(s[1:i]), 0)::BIGINT) AS t FROM z),
c AS (SELECT doc_id, un, n, t, 0 AS no, 0::BIGINT AS a, coalesce(list_filter(range(1, n), lambda e: t[e + 2] > t[1] + 1024)[1], n) AS b FROM p WHERE n > 0
  UNION ALL SELECT doc_id, un, n, t, no + 1, a2, coalesce(list_filter(range(b + 1, n), lambda e: t[e + 2] > t[a2 + 1] + 1024)[1], n)
  FROM (SELECT *, greatest(a, list_filter(range(0, b + 1), lambda j: t[b + 1] - t[j + 1] <= 500)[1]) AS a2 FROM c WHERE b < n)),
sentences AS (SELECT doc_id, no, list_filter(string_split(regexp_replace(array_to_string(un[a + 1:b], ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_matches(x, '\p{L}')) AS ss FROM c),
bullets AS (SELECT doc_id, no, list_transform(ss, lambda x: '- ' || array_to_string(regexp_split_to_array(trim(x), '\s+')[1:6], ' ')) AS bs FROM sentences),
once AS (SELECT doc_id, no, list_filter(bs, lambda x, i: list_position(bs, x) = i) AS bs FROM bullets),
folded AS (SELECT doc_id, no, """ + CLOSE_SQL.format("bs") + """ AS ls FROM once WHERE no = 0
  UNION ALL SELECT doc_id, no, """ + CLOSE_SQL.format("bs") + """ AS ls FROM (SELECT o.doc_id, o.no, list_filter(o.bs, lambda x: NOT list_contains(f.ls[-10:], x)) AS bs
  FROM folded f JOIN once o ON o.doc_id = f.doc_id AND o.no = f.no + 1)),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM folded),
summed AS (SELECT doc_id, any_value(k) AS n_chunk, string_agg(CASE WHEN k = 1 THEN '' ELSE CASE WHEN no > 0 THEN '- ---' || chr(10) ELSE '' END
  || '- Chunk ' || (no + 1) || '/' || k || chr(10) END || array_to_string(ls, chr(10)), chr(10) ORDER BY no) AS summary FROM sized GROUP BY doc_id)
"""


@query("summarise_chunks", SUMMARY_SQL + r"""SELECT d.doc_id, coalesce(n_chunk, 0)::INT AS n_chunk, coalesce(summary, '') AS summary,
  CAST(ceil(length(coalesce(summary, '')) / 4.0) AS BIGINT) AS sum_tkn_length,
  round(length(regexp_replace(coalesce(summary, ''), '[^\p{L}]', '', 'g')) / 6 / 250, 6) AS sum_reading_length
FROM documents d LEFT JOIN summed USING (doc_id)""")
def summarise_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = Z.summarize(docs, models.first_words_summary, context=2048)
    return done.select("doc_id", "n_chunk", "summary", "sum_tkn_length", F.round("sum_reading_length", 6).alias("sum_reading_length"))


@query("recursive_summary")
def recursive_summary(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = Z.summarize(docs, models.first_words_summary, context=2048, n_recursion=2)
    return done.select("doc_id", "n_chunk", F.size("recursive_summaries").alias("n_passes"), "summary", "sum_tkn_length")


# a tag as a whole word; a bracket before it says that it is a link already
TAG_SQL = r"(?i)(^|[^\p{{L}}\p{{N}}_\[]){0}([^\p{{L}}\p{{N}}_]|$)"
LINK_SQL = "regexp_replace({x}, '" + TAG_SQL + "', '\\1[[{0}]]\\2', 'g')"


def _linked_sql(x: str, tag: str) -> str:
    return LINK_SQL.format(tag, x=LINK_SQL.format(tag, x=x))  # twice, as neighbours share their gap


@query("tag_link", "WITH l AS (SELECT doc_id, string_split(" + _linked_sql(_linked_sql("text", "of the"), "dans") + """, chr(10)) AS li FROM documents)
SELECT doc_id, array_to_string(list_transform(li, lambda x: CASE WHEN regexp_matches(x, '""" + TAG_SQL.format("(the|la)") + r"""') THEN regexp_replace(x, '\s+$', '')
  || CASE WHEN regexp_matches(x, '""" + TAG_SQL.format("the") + """') THEN ' [[the]]' ELSE '' END
  || CASE WHEN regexp_matches(x, '""" + TAG_SQL.format("la") + """') THEN ' [[la]]' ELSE '' END ELSE x END), chr(10)) AS outline FROM l""")
def tag_link(spark, sf):
    longer, shorter = F.array(F.lit("of the"), F.lit("dans")), F.array(F.lit("the"), F.lit("la"))
    return table(spark, sf, "documents").select("doc_id", link_tags(F.col("text"), longer, shorter).alias("outline"))


@query("tag_extract", """
SELECT doc_id, array_to_string(list_transform(list_sort([{'n': length(lang), 't': lang}, {'n': length(source), 't': source},
  {'n': length(lang || ' ' || source), 't': lang || ' ' || source}]), lambda s: s.t), '|') AS tags, lang || '|' || source AS sub_tags FROM documents""")
def tag_extract(spark, sf):
    from corpusmill.sinks.outline import sub_tags

    reply = F.concat(F.lit("sure <tags>\n"), "lang", F.lit(" "), "source", F.lit("\n\n "), "source", F.lit("\n"), "lang", F.lit("\n</tags> done"))
    docs = table(spark, sf, "documents").select("doc_id", models.tags_in(reply).alias("t"))
    return docs.select("doc_id", F.array_join("t", "|").alias("tags"), F.array_join(sub_tags(F.col("t")), "|").alias("sub_tags"))
