"""Scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import answers, html, outline, selectors, text, timecode
from corpusmill.functions.filetypes import media_bucket
from corpusmill.registry import query, table


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 20) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("manifest_hash", """
SELECT page_id, substr(sha256('{"path":"' || url || '","filetype":"url"}'), 1, 20) AS file_hash FROM pages""")
def manifest_hash(spark, sf):
    entry = F.to_json(F.struct(F.col("url").alias("path"), F.lit("url").alias("filetype")))
    return table(spark, sf, "pages").select("page_id", text.content_hash(entry).alias("file_hash"))


HTML_NODES_SQL = r"""
nodes AS (
  SELECT page_id, regexp_extract_all(
    replace(replace(replace(replace(html, '</li><li>', '<br>'), '</ul><ul>', '<br>'), '<br>', chr(10)), '</br>', chr(10)),
    '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[a-z!/?][^>]*>|[^<]+|<') AS parts
  FROM pages)"""
DECODE_SQL = ("replace(replace(replace(replace(replace(replace(replace({x},'&lt;','<'),'&gt;','>'),'&quot;','\"'),"
              "'&nbsp;',chr(160)),'&copy;','©'),'&middot;','·'),'&amp;','&')")


@query("html_to_text", "WITH " + HTML_NODES_SQL + r""",
shown AS (SELECT page_id, list_filter(list_transform(parts, lambda n: CASE
    WHEN regexp_matches(n, '(?i)^<(script|style)\b[^>]*>')
      THEN trim(regexp_replace(n, '(?is)^<(script|style)\b[^>]*>|</(script|style)\s*>$', '', 'g'), chr(32)||chr(10)||chr(9)||chr(13))
    WHEN starts_with(n, '<!--') THEN trim(n[5:-4], chr(32)||chr(10)||chr(9)||chr(13))
    WHEN regexp_matches(n, '(?i)^<!doctype') THEN trim(n[10:-2], chr(32)||chr(10)||chr(9)||chr(13))
    WHEN regexp_matches(n, '(?i)^<img\b') THEN n
    WHEN regexp_matches(n, '(?i)^<[a-z!/?]') THEN ''
    ELSE trim(""" + DECODE_SQL.format(x="n") + r""", chr(32)||chr(10)||chr(9)||chr(13)) END), lambda n: n <> '') AS kept
  FROM nodes)
SELECT page_id, regexp_replace(array_to_string(kept, ' '), '\n{2,}', chr(10), 'g') AS content FROM shown""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.html_to_text(F.col("html")).alias("content"))


@query("src_html", r"""
WITH bare AS (SELECT page_id, url, regexp_replace(html,
    '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[a-z!/?][^>]*>', '', 'g') AS t FROM pages),
clean AS (SELECT page_id, url, trim(""" + DECODE_SQL.format(x="t") + r""", chr(32)||chr(10)||chr(9)||chr(13)) AS content FROM bare)
SELECT page_id, url AS path, content, substr(sha256(content), 1, 20) AS content_hash,
       round(length(content) / 6 / 250, 3) AS doc_reading_time FROM clean""")
def src_html(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("path"), html.clean_if_html(F.col("html")).alias("content"))
    return pages.withColumns({"content_hash": text.content_hash(F.col("content")),
                              "doc_reading_time": text.doc_reading_time(F.col("content"))})


@query("page_title", r"""
SELECT page_id, nullif(trim(""" + DECODE_SQL.format(x=r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
       + """, chr(32)||chr(10)||chr(9)), '') AS title FROM pages""")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query("fix_text", "SELECT doc_id, substr(sha256(text), 1, 20) AS repaired_hash FROM documents")
def fix_text(spark, sf):
    # every text is damaged first, so the check is that the damage is undone and nothing else
    damaged = table(spark, sf, "documents").select("doc_id", text.double_encode(F.col("text")).alias("t"))
    return damaged.select("doc_id", text.content_hash(text.repair_double_encoding(F.col("t"))).alias("repaired_hash"))


@query("cloze_strip", r"""
SELECT doc_id, regexp_replace(replace(text, ' ', '{{c1::x}}'), '\{\{c\d+::|\}\}', ' ', 'g') AS content FROM documents""")
def cloze_strip(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.replace(F.col("text"), F.lit(" "), F.lit("{{c1::x}}")).alias("t"))
    return docs.select("doc_id", text.strip_cloze(F.col("t")).alias("content"))


@query("media_placeholders", r"""
WITH cards AS (SELECT page_id, '<img alt="a" src="' || page_id || '.png"> seen at ' || url || ' [sound:n' || page_id || '.mp3]' AS c FROM pages),
parts AS (SELECT page_id, c, regexp_extract(c, '(?s)<img .*?src=.*?/?>') AS img, regexp_extract(c, '\[sound:\w+\.\w{2,3}\]') AS snd FROM cards),
links AS (SELECT *, regexp_extract(replace(replace(c, img, '[IMAGE_1]'), snd, '[SOUND_1]'),
    '[A-Za-z0-9]+://[A-Za-z0-9%-_]+(?:/[A-Za-z0-9%-_])*(?:#|\\?)[A-Za-z0-9%-_&=]*') AS link FROM parts)
SELECT page_id, replace(replace(replace(c, img, '[IMAGE_1]'), snd, '[SOUND_1]'), link, '[LINK_1]') AS content,
       '[IMAGE_1]=' || img || '|[SOUND_1]=' || snd || '|[LINK_1]=' || link AS media, true AS reversible FROM links""")
def media_placeholders(spark, sf):
    card = F.concat(F.lit('<img alt="a" src="'), F.col("page_id"), F.lit('.png"> seen at '), F.col("url"),
                    F.lit(" [sound:n"), F.col("page_id"), F.lit(".mp3]"))
    taken = (table(spark, sf, "pages").select("page_id", card.alias("c"))
             .withColumn("s", html.take_media(F.col("c"))))
    return taken.select(
        "page_id", F.col("s.content").alias("content"),
        F.array_join(F.transform("s.media", lambda m: F.concat(m["mark"], F.lit("="), m["media"])), "|").alias("media"),
        (html.put_media_back(F.col("s")) == F.col("c")).alias("reversible"))


@query("md_image", r"""
WITH n AS (SELECT doc_id, CASE WHEN pmod = 0 THEN lang ELSE source || '-' || lang || '-picture-number-' || doc_id END AS alt, text
  FROM (SELECT *, doc_id % 3 AS pmod FROM documents))
SELECT doc_id, 'see ' || CASE WHEN length(alt) <= 16 THEN alt ELSE alt[1:8] || '…' || alt[-8:] END || ' end '|| text AS named,
       'see [IMAGE] end ' || text AS marked FROM n""")
def md_image(spark, sf):
    alt = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("lang")).otherwise(
        F.concat("source", F.lit("-"), "lang", F.lit("-picture-number-"), "doc_id"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("see !["), alt, F.lit("](img/"), "doc_id", F.lit(".png) end "), "text").alias("t"))
    return docs.select("doc_id", text.markdown_images_to_name(F.col("t")).alias("named"),
                       text.markdown_images_to_mark(F.col("t")).alias("marked"))


@query("md_link", "SELECT doc_id, lang || ' and ' || source || ' ' || text AS content FROM documents")
def md_link(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("["), "lang", F.lit("](http://x.org/"), "doc_id", F.lit(") and ["), "source",
        F.lit("](https://y.org/?a=b) "), "text").alias("t"))
    return docs.select("doc_id", text.markdown_links_to_text(F.col("t")).alias("content"))


@query("reader_split", """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source || ' ' || lang END AS title,
       CASE WHEN doc_id % 4 <> 1 THEN chr(10) || text END AS body FROM documents""")
def reader_split(spark, sf):
    kind = F.pmod("doc_id", F.lit(4))
    reply = F.concat(F.when(kind != 0, F.lit("Title: ")).otherwise(F.lit("About ")), "source", F.lit(" "), "lang",
                     F.lit("\n\n"), F.when(kind != 1, F.lit("Markdown Content:")).otherwise(F.lit("Content:")),
                     F.lit("\n"), "text")
    docs = table(spark, sf, "documents").select("doc_id", reply.alias("r"))
    return docs.select("doc_id", text.reader_title(F.col("r")).alias("title"), text.reader_body(F.col("r")).alias("body"))


@query("reading_time", """
SELECT doc_id, round(length(text) / 6 / 250, 3) AS doc_reading_time FROM documents""")
def reading_time(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.doc_reading_time(F.col("text")).alias("doc_reading_time"))


@query("alpha_reading_time", r"""
SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / 6 / 250, 6) AS sum_reading_length FROM documents""")
def alpha_reading_time(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(
        text.reading_minutes(text.letters(F.col("text"))), 6).alias("sum_reading_length"))


@query("token_length", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tkn_length FROM documents")
def token_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.est_tokens(F.col("text")).alias("tkn_length"))


@query("split_query", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim(text) WHEN 1 THEN source END AS to_embed,
       CASE doc_id % 3 WHEN 2 THEN NULL ELSE trim(text) END AS to_answer, doc_id % 3 <> 2 AS valid FROM documents""")
def split_query(spark, sf):
    kind = F.pmod("doc_id", F.lit(3))
    asked = (F.when(kind == 0, F.col("text")).when(kind == 1, F.concat("source", F.lit(" >>>> "), "text"))
             .otherwise(F.concat("source", F.lit(">>>>"), "lang", F.lit(">>>>"), "text")))
    docs = table(spark, sf, "documents").select("doc_id", text.split_query(asked).alias("p"))
    return docs.select("doc_id", "p.to_embed", "p.to_answer", F.col("p").isNotNull().alias("valid"))


@query("think_answer", """
WITH d AS (SELECT doc_id, doc_id % 8 AS k, text, source, rtrim(text) AS rt FROM documents)
SELECT doc_id,
  CASE WHEN k IN (1, 2, 3, 4) THEN source ELSE '' END AS thinking,
  CASE k WHEN 0 THEN text WHEN 1 THEN rt WHEN 2 THEN rt WHEN 3 THEN chr(10) || rt WHEN 4 THEN rt WHEN 5 THEN rt
    ELSE '<note>' || chr(10) || 'The tags of this reply do not add up, so it is given as it came' || chr(10) ||
         '</note>' || chr(10) || '<output>' || chr(10) ||
         CASE k WHEN 6 THEN '<think>' || source || text ELSE text || '</answer>' END || chr(10) || '</output>' END AS answer,
  k < 6 AS ok FROM d""")
def think_answer(spark, sf):
    kind = F.pmod("doc_id", F.lit(8))
    cat = F.concat
    reply = (F.when(kind == 0, F.col("text"))
             .when(kind == 1, cat(F.lit("<think>"), "source", F.lit("</think><answer>"), "text", F.lit("</answer>")))
             .when(kind == 2, cat("source", F.lit("</think><answer>"), "text", F.lit("</answer>")))
             .when(kind == 3, cat(F.lit("<think>"), "source", F.lit("<answer>"), "text", F.lit("</answer>")))
             .when(kind == 4, cat(F.lit("<think>"), "source", F.lit("</think>"), "text"))
             .when(kind == 5, cat(F.lit("<answer>"), "text", F.lit("</answer>")))
             .when(kind == 6, cat(F.lit("<think>"), "source", "text"))
             .otherwise(cat("text", F.lit("</answer>"))))
    docs = table(spark, sf, "documents").select("doc_id", reply.alias("r"))
    return docs.select("doc_id", answers.think_answer(F.col("r")).alias("p")).select("doc_id", "p.*")


@query("parse_score", r"""
SELECT doc_id, CAST(CASE doc_id % 8
    WHEN 0 THEN doc_id % 11 WHEN 1 THEN doc_id % 11 WHEN 2 THEN doc_id % 11 WHEN 3 THEN doc_id % 11
    WHEN 6 THEN doc_id % 11 ELSE 5 END AS BIGINT) AS score FROM documents""")
def parse_score(spark, sf):
    kind, n = F.pmod("doc_id", F.lit(8)), F.pmod("doc_id", F.lit(11)).cast("string")
    reply = (F.when(kind == 0, n)
             .when(kind == 1, F.concat(F.lit("<think>"), "text", F.lit("</think><answer>"), n, F.lit("</answer>")))
             .when(kind == 2, F.concat(F.lit("-"), n))
             .when(kind == 3, F.concat(F.lit("Score:\n"), n, F.lit("\nbecause")))
             .when(kind == 4, F.concat(n, F.lit(" out of 10")))
             .when(kind == 5, F.lit("  "))
             .when(kind == 6, F.concat(F.lit("I say "), n, F.lit(".")))
             .otherwise(F.lit("no idea")))
    return table(spark, sf, "documents").select("doc_id", answers.parse_score(reply).alias("score"))


@query("irrelevant_filter", """
SELECT doc_id FROM documents WHERE doc_id % 4 NOT IN (1, 2) OR (doc_id % 4 = 1 AND length(text) >= 9)""")
def irrelevant_filter(spark, sf):
    kind = F.pmod("doc_id", F.lit(4))
    reply = (F.when(kind == 0, F.lit("yes")).when(kind == 1, F.concat(F.lit("IRRELEVANT "), "text"))
             .when(kind == 2, F.concat(F.lit("<answer>IRRELEVANT</answer>"), "text")).otherwise(F.col("text")))
    return (table(spark, sf, "documents").withColumn("answer", reply)
            .filter(answers.is_relevant(F.col("answer"))).select("doc_id"))


@query("source_replace", """
SELECT doc_id, replace(text, ' ', ' [2](#document-2)x [21](#document-21) ') || '[1](#document-1)' AS answer FROM documents""")
def source_replace(spark, sf):
    answer = F.concat(F.replace("text", F.lit(" "), F.lit(" SRC_2x SRC_21 ")), F.lit("SRC_1"))
    ids = F.array(F.lit(1), F.lit(2), F.lit(21))
    return table(spark, sf, "documents").select("doc_id", text.source_replace(answer, ids, "SRC_").alias("answer"))


@query("citation_link", """
SELECT doc_id, '- ' || text || ' [p.' || doc_id || '](http://v/' || source || '#page=' || doc_id || ') and [p.7](http://v/f '
       || lang || '.pdf#page=7)' AS summary FROM documents""")
def citation_link(spark, sf):
    summary = F.concat(F.lit("- "), "text", F.lit(" [p."), "doc_id", F.lit("] and [p.7, f "), "lang", F.lit(".pdf]"))
    docs = table(spark, sf, "documents").select("doc_id", "source", summary.alias("s"))
    linked = text.citation_links(F.col("s"), "http://v/{source}#page={page}", F.col("source"))
    return docs.select("doc_id", linked.alias("summary"))


BULLETS_SQL = r"""
lines AS (SELECT doc_id, string_split(text, chr(10)) AS li FROM documents),
dressed AS (SELECT doc_id, list_transform(range(1, len(li) + 1), lambda i: CASE (doc_id + i) % 7
    WHEN 0 THEN '* ' || li[i] WHEN 1 THEN '—' || li[i] WHEN 2 THEN chr(9) || '-' || li[i]
    WHEN 3 THEN '- • ' || li[i] WHEN 4 THEN '- **' || li[i] WHEN 5 THEN '12 34' ELSE li[i] END) AS li FROM lines),
s1 AS (SELECT doc_id, list_transform(list_filter(li, lambda x: regexp_matches(x, '\p{L}')),
    lambda x: replace(replace(replace(regexp_replace(x, '\s+$', ''), chr(9), '    '), '- • ', '- '), '• ', '- ')) AS li FROM dressed),
s2 AS (SELECT doc_id, list_transform(li, lambda x: regexp_replace(x, '^(\s*)\* ', '\1- ')) AS li FROM s1),
s3 AS (SELECT doc_id, list_transform(li, lambda x: CASE WHEN regexp_matches(x, '^\s*—') THEN replace(x, '—', '-') ELSE x END) AS li FROM s2),
s4 AS (SELECT doc_id, list_transform(li, lambda x: regexp_replace(x, '^(\s*)-([^ ])', '\1- \2')) AS li FROM s3),
s5 AS (SELECT doc_id, list_transform(li, lambda x: replace(CASE WHEN starts_with(ltrim(x), '- ') THEN x
    ELSE regexp_replace(x, '^(\s*)(\S)', '\1- \2') END, '****', '')) AS li FROM s4),
s6 AS (SELECT doc_id, list_transform(li, lambda x: CASE WHEN len(string_split(x, '**')) % 2 = 0 THEN x || '**' ELSE x END) AS li FROM s5),
s7 AS (SELECT doc_id, list_transform(li, lambda x: CASE WHEN len(string_split(x, '*')) % 2 = 0 THEN x || '*' ELSE x END) AS li FROM s6)"""


def dressed_lines():
    """The lines of a document, dressed up in the ways models get bullets wrong."""
    def dress(line, i):
        kind = F.pmod(F.col("doc_id") + i + 1, F.lit(7))
        return (F.when(kind == 0, F.concat(F.lit("* "), line)).when(kind == 1, F.concat(F.lit("—"), line))
                .when(kind == 2, F.concat(F.lit("\t-"), line)).when(kind == 3, F.concat(F.lit("- • "), line))
                .when(kind == 4, F.concat(F.lit("- **"), line)).when(kind == 5, F.lit("12 34")).otherwise(line))

    return F.array_join(F.transform(F.split("text", "\n"), dress), "\n")


@query("bullet_normalise", "WITH " + BULLETS_SQL + " SELECT doc_id, array_to_string(li, chr(10)) AS bullets FROM s7")
def bullet_normalise(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", dressed_lines().alias("t"))
    return docs.select("doc_id", F.array_join(outline.good_lines(F.col("t")), "\n").alias("bullets"))


@query("citation_fallback", "WITH " + BULLETS_SQL + r"""
SELECT doc_id, array_to_string(list_transform(li, lambda x: CASE
    WHEN doc_id % 4 = 0 OR NOT starts_with(x, '- ') THEN x
    WHEN doc_id % 4 = 1 THEN rtrim(x) || ' [p.' || doc_id || ', ' || source || ']' ELSE rtrim(x) || ' [p.' || doc_id || ']' END), chr(10)) AS bullets
FROM s7 JOIN documents USING (doc_id)""")
def citation_fallback(spark, sf):
    kind = F.pmod("doc_id", F.lit(4))
    docs = table(spark, sf, "documents").select(
        "doc_id", outline.good_lines(dressed_lines()).alias("li"),
        F.when(kind != 0, F.col("doc_id")).alias("page"), F.when(kind == 1, F.col("source")).alias("label"))
    return docs.select("doc_id", F.array_join(
        outline.cite_fallback(F.col("li"), F.col("page"), F.col("label")), "\n").alias("bullets"))


@query("strip_intro", """
WITH l AS (SELECT doc_id, doc_id % 5 AS k, string_split(text, chr(10)) AS li FROM documents)
SELECT doc_id, array_to_string(list_concat(CASE k WHEN 2 THEN ['- ready' || repeat(' x', 60)] WHEN 3 THEN ['  deep breath'] ELSE [] END,
   list_filter(li, lambda x: NOT (length(x) < 100 AND (contains(lower(x), 'deep breath') OR starts_with(lower(x), 'i''ll summarize'))))), chr(10)) AS summary
FROM l""")
def strip_intro(spark, sf):
    kind = F.pmod("doc_id", F.lit(5))
    head = (F.when(kind == 0, F.lit("Taking a deep breath first")).when(kind == 1, F.lit("I'll summarize this"))
            .when(kind == 2, F.lit("- ***Deep Breaths*** - ready" + " x" * 60)).when(kind == 3, F.lit("  deep breath"))
            .otherwise(F.lit("I'll summarize the text")))
    lines = F.concat(F.array(head), F.split("text", "\n"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(outline.strip_intro(lines), "\n").alias("summary"))


@query("strip_markers", r"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: rtrim(x)) AS li FROM documents)
SELECT doc_id, array_to_string(list_concat(list_filter(li, lambda x: x <> ''),
    CASE WHEN doc_id % 2 = 1 THEN ['last'] ELSE [] END), chr(10)) AS summary FROM l""")
def strip_markers(spark, sf):
    summary = F.concat(F.lit("- Chunk 1/2\n"), "text", F.lit("\n- ---\n- Chunk 2/2\n"),
                       F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("- BEFORE RECURSION #1\n")).otherwise(F.lit("")),
                       F.lit("last"))
    return table(spark, sf, "documents").select("doc_id", outline.strip_recursion_marks(summary).alias("summary"))


@query("timecode", """
WITH d AS (SELECT event_id, CAST(floor(value + event_id) AS BIGINT) AS s FROM events)
SELECT event_id, printf('%02d', s // 3600) || ':' ||
    lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS code,
    s AS seconds, CAST(NULL AS BIGINT) AS from_words FROM d""")
def timecode_query(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "event_type", timecode.seconds_to_timecode(F.col("value") + F.col("event_id")).alias("code"))
    return events.select("event_id", "code", timecode.timecode_to_seconds(F.col("code")).alias("seconds"),
                         timecode.timecode_to_seconds(F.col("event_type")).alias("from_words"))


SEGMENTS_SQL = """
segs AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS li FROM documents),
timed AS (SELECT doc_id, li, list_transform(range(1, len(li) + 1), lambda i: (i - 1) * (4 + doc_id % 9)) AS st FROM segs)"""
CODE_SQL = ("lpad(CAST(({s}) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({s}) % 3600 // 60 AS VARCHAR), 2, '0')"
            " || ':' || lpad(CAST(({s}) % 60 AS VARCHAR), 2, '0')")


def caption_segments():
    """Each line of a document as a caption, a fixed number of seconds after the one before."""
    step = 4 + F.pmod("doc_id", F.lit(9))
    lines = F.filter(F.split("text", "\n"), lambda li: li != "")
    return F.transform(lines, lambda li, i: F.struct(
        (i * step).alias("start"), ((i + 1) * step).alias("end"), li.alias("text")))


@query("segments_to_vtt", "WITH " + SEGMENTS_SQL + """
SELECT doc_id, array_to_string(list_transform(range(1, len(li) + 1), lambda i:
    """ + CODE_SQL.format(s="st[i]") + " || '.0 --> ' || " + CODE_SQL.format(s="st[i] + 4 + doc_id % 9")
       + """ || chr(10) || li[i]), chr(10) || chr(10)) AS vtt FROM timed""")
def segments_to_vtt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", timecode.segments_to_vtt(caption_segments()).alias("vtt"))


@query("timecode_decimate", "WITH RECURSIVE " + SEGMENTS_SQL + """,
kept AS (
  SELECT doc_id, st, list_filter(st, lambda s: s >= 14)[1] AS t0 FROM timed
  UNION ALL
  SELECT doc_id, st, list_filter(st, lambda s: s >= t0 + 15)[1] FROM kept WHERE t0 IS NOT NULL),
spans AS (
  SELECT k.doc_id, t0, lead(t0) OVER (PARTITION BY k.doc_id ORDER BY t0) AS t1, timed.li, timed.st AS s
  FROM kept k JOIN timed ON timed.doc_id = k.doc_id WHERE t0 IS NOT NULL),
texts AS (
  SELECT doc_id, t0, list_filter(list_transform(list_filter(range(1, len(li) + 1),
      lambda i: s[i] >= t0 AND (t1 IS NULL OR s[i] < t1)), lambda i: regexp_replace(li[i], '^\\s+|\\s+$', '', 'g')),
      lambda x: x <> '') AS said FROM spans),
lines AS (
  SELECT doc_id, t0, list_reduce(list_prepend(""" + CODE_SQL.format(s="t0") + """ || coalesce(' ' || said[1], ''), said[2:]),
      lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || ' ' || x END) AS line FROM texts)
SELECT d.doc_id, count(t0) AS n_codes, coalesce(string_agg(line, chr(10) ORDER BY t0), '') AS transcript
FROM timed d LEFT JOIN lines ON lines.doc_id = d.doc_id GROUP BY d.doc_id""")
def timecode_decimate(spark, sf):
    captions = table(spark, sf, "documents").select(
        "doc_id", timecode.segments_to_vtt(caption_segments()).alias("vtt"))
    lines = captions.select("doc_id", timecode.compact_transcript(F.col("vtt"), drop_hour=False).alias("transcript"))
    codes = F.regexp_count("transcript", F.lit(r"(?m)^\d\d:\d\d:\d\d"))
    return lines.select("doc_id", codes.cast("bigint").alias("n_codes"), "transcript")


@query("selector_a", """
WITH s AS (SELECT doc_id, doc_id % 7 AS k, source, lang FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'library' WHEN 1 THEN 'tag' WHEN 2 THEN 'items' WHEN 3 THEN 'search'
    WHEN 4 THEN 'collection' WHEN 5 THEN 'collection' ELSE 'collection' END AS kind,
  CASE k WHEN 0 THEN '' WHEN 1 THEN source || '|' || lang WHEN 2 THEN source WHEN 3 THEN source || ', ' || lang WHEN 4 THEN lang
    WHEN 5 THEN source || '/' || lang ELSE 'odd:' || lang END AS selected FROM s""")
def selector_a(spark, sf):
    kind = F.pmod("doc_id", F.lit(7))
    asked = (F.when(kind == 0, F.lit(" Library ")).when(kind == 1, F.concat(F.lit("tag: "), "source", F.lit(" , "), "lang"))
             .when(kind == 2, F.concat(F.lit("KEY:"), "source", F.lit(",")))
             .when(kind == 3, F.concat(F.lit("savedsearch:"), "source", F.lit(", "), "lang"))
             .when(kind == 4, F.concat(F.lit("col : "), "lang")).when(kind == 5, F.concat("source", F.lit("/"), "lang"))
             .otherwise(F.concat(F.lit("odd:"), "lang")))
    docs = table(spark, sf, "documents").select("doc_id", selectors.reference_selector(asked).alias("s"))
    return docs.select("doc_id", "s.kind", F.array_join("s.values", "|").alias("selected"))


@query("selector_b", """
WITH s AS (SELECT doc_id, doc_id % 8 AS k, source, lang FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'library' WHEN 1 THEN 'favourites' WHEN 2 THEN 'archived' WHEN 3 THEN 'tag'
    WHEN 4 THEN 'ids' WHEN 5 THEN 'search' WHEN 6 THEN 'list' ELSE 'list' END AS kind,
  CASE WHEN k < 3 THEN '' WHEN k = 3 THEN source || ',' || lang WHEN k = 4 THEN source || '|' || lang
    WHEN k = 5 THEN lang WHEN k = 6 THEN source ELSE lang END AS selected FROM s""")
def selector_b(spark, sf):
    kind = F.pmod("doc_id", F.lit(8))
    asked = (F.when(kind == 0, F.lit("*")).when(kind == 1, F.lit("Favorites")).when(kind == 2, F.lit("archived"))
             .when(kind == 3, F.concat(F.lit("tag:"), "source", F.lit(","), "lang"))
             .when(kind == 4, F.concat(F.lit("bookmarks: "), "source", F.lit(", "), "lang"))
             .when(kind == 5, F.concat(F.lit("search:"), "lang")).when(kind == 6, F.concat(F.lit("lst:"), "source"))
             .otherwise(F.col("lang")))
    docs = table(spark, sf, "documents").select("doc_id", selectors.bookmark_selector(asked).alias("s"))
    return docs.select("doc_id", "s.kind", F.array_join("s.values", "|").alias("selected"))


@query("header_lines", """
SELECT c_custkey, concat_ws(chr(10), 'Title: ' || c_name, CASE WHEN c_acctbal > 0 THEN 'Author: ' || c_mktsegment END,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Tags: ' || c_mktsegment || ', ' || c_nationkey END, 'Item id: ' || c_custkey) AS header
FROM customer""")
def header_lines(spark, sf):
    from corpusmill.sources.headers import labelled_lines

    tags = F.when(F.pmod("c_nationkey", F.lit(2)) == 0, F.concat_ws(", ", "c_mktsegment", "c_nationkey"))
    author = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    header = labelled_lines({"Title": F.col("c_name"), "Author": author, "Note": F.lit(""), "Tags": tags,
                             "Item id": F.col("c_custkey").cast("string")})
    return table(spark, sf, "customer").select("c_custkey", header.alias("header"))


@query("is_local_host", r"""
WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'http://localhost:3000/' || page_id
    WHEN 2 THEN 'http://10.0.0.' || page_id WHEN 3 THEN 'http://172.' || page_id % 40 || '.1.1/a'
    WHEN 4 THEN 'https://nas.local/x' ELSE 'http://192.168.1.9' END AS url FROM pages)
SELECT page_id, url, page_id % 6 IN (1, 2, 4, 5) OR (page_id % 6 = 3 AND page_id % 40 BETWEEN 16 AND 31) AS is_local FROM u""")
def is_local_host(spark, sf):
    kind, n = F.pmod("page_id", F.lit(6)), F.col("page_id").cast("string")
    url = (F.when(kind == 0, F.col("url")).when(kind == 1, F.concat(F.lit("http://localhost:3000/"), n))
           .when(kind == 2, F.concat(F.lit("http://10.0.0."), n))
           .when(kind == 3, F.concat(F.lit("http://172."), F.pmod("page_id", F.lit(40)).cast("string"), F.lit(".1.1/a")))
           .when(kind == 4, F.lit("https://nas.local/x")).otherwise(F.lit("http://192.168.1.9")))
    pages = table(spark, sf, "pages").select("page_id", url.alias("url"))
    return pages.select("page_id", "url", text.is_local_host(F.col("url")).alias("is_local"))


@query("template_fill", """
SELECT c_custkey, 'Name: ' || c_name || ' (' || c_mktsegment || ')' || chr(10) || chr(10) ||
    'name: ''' || c_name || '''' || chr(10) || chr(10) || 'segment: ''' || c_mktsegment || '''' AS card FROM customer""")
def template_fill(spark, sf):
    from corpusmill.sources.cards import fill_template

    card = fill_template("Name: {name} ({segment})\n\n{allfields}",
                         F.array(F.lit("name"), F.lit("note"), F.lit("segment")),
                         F.array(F.col("c_name"), F.lit(" "), F.col("c_mktsegment")))
    return table(spark, sf, "customer").select("c_custkey", card.alias("card"))


@query("parse_scalar", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'bool' WHEN 1 THEN 'bool' WHEN 2 THEN 'int' WHEN 3 THEN 'none' WHEN 4 THEN 'none' ELSE 'str' END AS kind,
  CASE doc_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN CAST(doc_id AS VARCHAR) WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE source END AS value
FROM documents""")
def parse_scalar(spark, sf):
    kind = F.pmod("doc_id", F.lit(6))
    raw = (F.when(kind == 0, F.lit("True")).when(kind == 1, F.lit("FALSE"))
           .when(kind == 2, F.concat(F.lit("00"), F.col("doc_id").cast("string")))
           .when(kind == 3, F.lit("None")).when(kind == 4, F.lit("")).otherwise(F.col("source")))
    return table(spark, sf, "documents").select("doc_id", text.parse_scalar(raw).alias("p")).select("doc_id", "p.*")


@query("path_basename", r"""
SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS name, replace(url, 'http://', '~') AS hidden FROM pages""")
def path_basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.path_basename(F.col("url")).alias("name"),
                                            text.hide_home(F.col("url"), "http://").alias("hidden"))


@query("media_url_bucket", """
SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'url_regex' WHEN page_id % 6 = 0 THEN 'media' WHEN page_id % 6 = 1 THEN 'mpeg'
    WHEN page_id % 6 = 2 THEN 'm3u' WHEN page_id % 6 = 3 THEN 'mp4' ELSE 'nonmedia' END AS bucket FROM pages""")
def media_url_bucket(spark, sf):
    kind = F.pmod("page_id", F.lit(6))
    requested = F.when(kind == 2, F.concat("url", F.lit(".m3u8"))).when(
        kind == 3, F.concat("url", F.lit(".mp4"))).otherwise(F.col("url"))
    resource = F.when(kind == 0, F.lit("multimedia")).when(kind == 1, F.lit("audio/mpeg")).otherwise(F.lit("document"))
    return table(spark, sf, "pages").select("page_id", media_bucket(requested, resource, url_regex="https").alias("bucket"))
