"""Loaders, manifests and libraries, fed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import content_hash
from corpusmill.operators import documents
from corpusmill.operators.tree import descendants
from corpusmill.plans.catalog.text import DECODE_SQL
from corpusmill.registry import query, table
from corpusmill.sources import bookmarks, cards, files, library, manifest, media, pipeline


@query("src_text", """
SELECT doc_id, 'txt' AS filetype, 'doc/' || doc_id AS path, 'doc/' || doc_id AS source, coalesce(CASE WHEN doc_id % 4 = 0 THEN 'T' || doc_id END, 'Untitled') AS title,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unset' END AS source_tag, substr(sha256(text), 1, 20) AS content_hash,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS tkn_length, round(length(text) / 6 / 250, 3) AS doc_reading_time, lang AS author,
  substr(sha256(substr(sha256(text), 1, 20) || '{"author":"' || lang || '"}'), 1, 20) AS all_hash FROM documents""")
def src_text(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("doc/"), "doc_id").alias("path"), F.lit("txt").alias("filetype"), F.col("text").alias("page_content"),
        F.when(F.pmod("doc_id", F.lit(4)) == 0, F.concat(F.lit("T"), "doc_id")).alias("title"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("source")).alias("source_tag"),
        documents.metadata_map({"Authors": F.col("lang")}).alias("metadata"))
    done = documents.finish(docs, content_hash(F.col("page_content")))
    return done.select("doc_id", "filetype", "path", "source", "title", "source_tag", "content_hash", "tkn_length",
                       "doc_reading_time", F.col("metadata")["author"].alias("author"), "all_hash")


@query("src_json_dict", """
SELECT event_id, 'k = ' || json_extract_string(props, '$.k') AS page_content FROM events
UNION ALL SELECT event_id, 'kind = ' || event_type FROM events""")
def src_json_dict(spark, sf):
    both = F.to_json(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(
        F.lit("kind"), F.col("event_type"), F.lit("skip"), F.lit("x"))))
    events = table(spark, sf, "events").select("event_id", both.alias("body"))
    return files.json_dict_docs(events, "body", "{key} = {value}", exclude=["skip"])


@query("src_outline_md")
def src_outline_md(spark, sf):
    # every line is a block; the properties of a block follow it
    lines = F.transform(F.split("text", "\n"), lambda li, i: F.concat(
        F.lit("- "), li, F.lit("\n  lang:: "), F.col("lang"), F.lit("\n  part:: "), F.pmod(i, F.lit(3)).cast("string")))
    page = F.concat(F.lit("source:: "), F.col("source"), F.lit("\n"), F.array_join(lines, "\n"))
    pages = table(spark, sf, "documents").select("doc_id", page.alias("text"))
    chunks = files.outline_chunks(pages, 256, 32)
    shown = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return chunks.select("doc_id", "chunk_no", content_hash(F.col("page_content")).alias("content_hash"),
                         shown.alias("metadata"), F.round("unmatched", 6).alias("unmatched"))


@query("url_fallback", """
WITH t AS (SELECT page_id, url, html, CASE WHEN page_id % 3 = 0 THEN 'short' END AS a, CASE WHEN page_id % 3 = 1 THEN repeat(url, 4) END AS b FROM pages)
SELECT page_id, CASE WHEN b IS NOT NULL AND ceil(length(b) / 4.0) > 20 THEN 'second' ELSE 'plain' END AS parser,
  length(CASE WHEN b IS NOT NULL AND ceil(length(b) / 4.0) > 20 THEN b ELSE html END)::BIGINT AS n_chars FROM t""")
def url_fallback(spark, sf):
    kind = F.pmod("page_id", F.lit(3))
    found = media.first_passing({"reader": F.when(kind == 0, F.lit("short")),
                                 "second": F.when(kind == 1, F.repeat("url", F.lit(4))), "plain": F.col("html")})
    pages = table(spark, sf, "pages").select("page_id", found.alias("f"))
    return pages.select("page_id", "f.parser", F.length("f.content").cast("bigint").alias("n_chars"))


@query("subtitle_pick", """
WITH tracks AS (SELECT conv_id, turn AS pos, CASE WHEN turn % 2 = 0 THEN 'auto' ELSE 'manual' END AS kind,
  CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'fr-orig' WHEN turn % 3 = 0 THEN 'en' WHEN turn % 3 = 1 THEN 'de' ELSE 'en-US' END AS lang FROM conversations),
o AS (SELECT *, CASE kind WHEN 'manual' THEN 0 ELSE 1 END AS o FROM tracks),
orig AS (SELECT conv_id, arg_min(lang, (o, pos)) AS orig FROM o WHERE ends_with(lang, '-orig') GROUP BY conv_id),
w AS (SELECT o.*, CASE WHEN orig IS NOT NULL THEN CASE WHEN lang = orig THEN 1 END ELSE list_position(['en', 'en-US', 'en-UK'], lang) END AS p
  FROM o LEFT JOIN orig USING (conv_id))
SELECT conv_id, arg_min(kind, (o, p, pos)) AS kind, arg_min(lang, (o, p, pos)) AS lang FROM w WHERE p > 0 GROUP BY conv_id""")
def subtitle_pick(spark, sf):
    turn = F.col("turn")
    lang = (F.when((F.pmod("conv_id", F.lit(3)) == 0) & (turn == 1), "fr-orig").when(F.pmod(turn, F.lit(3)) == 0, "en")
            .when(F.pmod(turn, F.lit(3)) == 1, "de").otherwise("en-US"))
    tracks = table(spark, sf, "conversations").select(
        "conv_id", turn.alias("pos"), F.when(F.pmod(turn, F.lit(2)) == 0, "auto").otherwise("manual").alias("kind"), lang.alias("lang"))
    return media.pick_subtitle(tracks, ["conv_id"])


@query("card_notes", """
WITH c AS (SELECT l_orderkey AS nid, l_linenumber AS ln, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 'Other' ELSE 'Lang::' || l_returnflag END AS deck,
  l_linestatus, l_shipdate, o_orderpriority, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_returnflag <> 'R' AND o_orderpriority <> '5-LOW'),
n AS (SELECT nid, arg_min(deck, ln * 1000000 + l_partkey) AS deck, any_value(o_orderpriority) AS prio, any_value(o_orderstatus) AS st FROM c
  WHERE starts_with(deck, 'Lang') GROUP BY nid),
t AS (SELECT nid, deck, prio, 'front: ''' || prio || '''' || chr(10) || chr(10) || 'back: ''' || st || ' ' || nid % 50 || '''' AS page_content FROM n)
SELECT min(nid) AS nid, arg_min(deck, nid) AS anki_deck, page_content, any_value(prio) AS anki_tags FROM t GROUP BY page_content""")
def card_notes(spark, sf):
    items, notes = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    deck = F.when(F.pmod("l_partkey", F.lit(5)) == 0, F.lit("Other")).otherwise(F.concat(F.lit("Lang\x1f"), "l_returnflag"))
    joined = items.join(notes, items.l_orderkey == notes.o_orderkey).select(
        (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("cid"), F.col("l_orderkey").alias("nid"),
        F.lit("").alias("codeck"), deck.alias("cdeck"), F.lit("Basic").alias("nmodel"), F.array("o_orderpriority").alias("ntags"),
        F.array(F.concat(F.lit("{{c1::"), F.col("o_orderpriority"), F.lit("}}")),
                F.concat(F.lit("<b>"), "o_orderstatus", F.lit("</b>"), F.pmod("o_orderkey", F.lit(50)).cast("string")), F.lit(" ")).alias("nflds"),
        F.array(F.lit("Front"), F.lit("Back"), F.lit("Extra")).alias("fields_name"),
        F.when(F.col("l_returnflag") == "R", "suspended").otherwise("new").alias("cqueue"), F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("cmod"))
    docs = cards.load_cards(joined, deck="Lang", notetype="basic", tag_filter="[1-4]")
    return docs.select("nid", "anki_deck", "page_content", "anki_tags")


@query("json_lines_manifest", """
SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 4 = 1 THEN 'txt' ELSE 'auto' END AS filetype, 'mine' AS source_tag
FROM events WHERE event_id % 4 < 2""")
def json_lines_manifest(spark, sf):
    kind = F.pmod("event_id", F.lit(4))
    line = (F.when(kind == 0, F.concat(F.lit("- "), "props")).when(kind == 1, F.regexp_replace("props", r"\}$", ', "filetype": "txt"}'))
            .when(kind == 2, F.concat(F.lit("# "), "props")).otherwise(F.lit("   ")))
    lines = table(spark, sf, "events").select("event_id", line.alias("line"))
    entries = manifest.json_lines(lines, "line", {"source_tag": "mine", "filetype": "json_entries"})
    return entries.select("event_id", *[F.col("args")[k].alias(k) for k in ("k", "filetype", "source_tag")])


@query("link_lines", "SELECT page_id, url AS path FROM pages WHERE page_id % 3 < 2")
def link_lines(spark, sf):
    kind = F.pmod("page_id", F.lit(3))
    line = (F.when(kind == 0, F.concat(F.lit("- [see]("), "url", F.lit(") now"))).when(kind == 1, F.concat(F.lit("- "), "url"))
            .otherwise(F.lit("no link here")))
    return manifest.link_lines(table(spark, sf, "pages").select("page_id", line.alias("line")), "line")


@query("manifest_fixpoint", """
WITH RECURSIVE w AS (SELECT 0::BIGINT AS n, 0 AS round UNION ALL
  SELECT p.page_id, w.round + 1 FROM w JOIN pages p ON p.page_id > 0 AND (p.page_id - 1) // 3 = w.n)
SELECT 'entry/' || n AS path, 'txt' AS filetype, round FROM w WHERE 3 * n + 1 > (SELECT max(page_id) FROM pages)""")
def manifest_fixpoint(spark, sf):
    pages = table(spark, sf, "pages").select("page_id")
    last = pages.agg(F.max("page_id")).scalar()
    number = F.split_part("path", F.lit("/"), F.lit(2)).cast("bigint")
    typed = pages.withColumn("filetype", F.when(3 * F.col("page_id") + 1 > last, "txt").otherwise("json_entries"))
    entries = typed.select(F.floor((F.col("page_id") - 1) / 3).alias("parent"),
                           F.concat(F.lit("entry/"), "page_id").alias("path"), "filetype")

    def children_of(pending):
        held = pending.select(number.alias("parent"))
        return entries.filter(F.col("path") != "entry/0").join(held, "parent").select("path", "filetype")

    return manifest.expand(entries.filter(F.col("path") == "entry/0").select("path", "filetype"), children_of)


LOADED_SQL = r"""
bare AS (SELECT page_id, url, html, regexp_replace(html,
    '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[a-z!/?][^>]*>', '', 'g') AS t FROM pages),
entries AS (
  SELECT 'doc/' || doc_id || '.txt' AS path, 'txt' AS filetype, CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(9) ELSE text END AS body,
    coalesce(CASE WHEN doc_id % 4 = 0 THEN lang END, 'Untitled') AS title, source AS source_tag FROM documents
  UNION ALL SELECT url, 'url', trim(""" + DECODE_SQL.format(x="t") + r""", chr(32)||chr(10)||chr(9)||chr(13)),
    coalesce(nullif(trim(""" + DECODE_SQL.format(x=r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r""", chr(32)||chr(10)||chr(9)), ''), 'Untitled'), 'unset' FROM bare
  UNION ALL SELECT 'part/' || p_partkey || '.xyz', 'odd', NULL, NULL, NULL FROM part WHERE p_partkey % 10 = 0),
judged AS (SELECT *, CASE WHEN filetype = 'odd' THEN 'no loader for odd' WHEN NOT regexp_matches(body, '\S') THEN 'empty document'
    WHEN CAST(ceil(length(body) / 4.0) AS BIGINT) <= 20 THEN 'too few tokens' WHEN round(length(body) / 6 / 250, 3) <= 0.1 THEN 'too short to read' END AS load_error FROM entries),
good AS (SELECT *, substr(sha256(body), 1, 20) AS content_hash FROM judged WHERE load_error IS NULL),
tags AS (SELECT content_hash, string_agg(source_tag, ' ' ORDER BY first_at) AS tags FROM (
    SELECT content_hash, source_tag, min(path) AS first_at FROM good GROUP BY ALL) GROUP BY content_hash)"""


@query("load_pipeline", "WITH " + LOADED_SQL + """
SELECT min(path) AS path, arg_min(filetype, path) AS filetype, g.content_hash, count(*) AS n_copies, any_value(tags) AS source_tag,
  arg_min(title, path) AS title, CAST(ceil(length(any_value(body)) / 4.0) AS BIGINT) AS tkn_length, NULL::VARCHAR AS load_error
FROM good g JOIN tags USING (content_hash) GROUP BY g.content_hash
UNION ALL SELECT path, filetype, NULL, NULL, NULL, NULL, NULL, load_error FROM judged WHERE load_error IS NOT NULL""")
def load_pipeline(spark, sf):
    """A manifest of lists of documents, web pages and files nobody can read: what is loaded, and what is not and why."""
    docs, pages, parts = (table(spark, sf, t) for t in ("documents", "pages", "part"))
    own = lambda **args: documents.metadata_map(args)
    lists = docs.select("source").distinct().select(
        F.concat(F.lit("list/"), "source").alias("path"), F.lit("json_entries").alias("filetype"), own(source_tag=F.col("source")).alias("args"))
    urls = pages.select(F.col("url").alias("path"), F.lit("url").alias("filetype"), own(none=F.lit(None)).alias("args"))
    odd = parts.filter("p_partkey % 10 = 0").select(
        F.concat(F.lit("part/"), "p_partkey", F.lit(".xyz")).alias("path"), F.lit("odd").alias("filetype"), own(none=F.lit(None)).alias("args"))
    path = F.concat(F.lit("doc/"), "doc_id", F.lit(".txt"))

    def listed(pending):
        held = docs.select(F.concat(F.lit("list/"), "source").alias("list"), path.alias("child"), F.when(
            F.pmod("doc_id", F.lit(4)) == 0, F.col("lang")).alias("title"))
        joined = pending.join(held, F.col("path") == F.col("list"))
        return joined.select(F.col("child").alias("path"), F.lit("auto").alias("filetype"),
                             pipeline.inherit(own(title=F.col("title")), F.col("args")).alias("args"))

    def texts(entries):
        body = F.when(F.pmod("doc_id", F.lit(9)) == 0, F.lit(" \t")).otherwise(F.col("text"))
        return docs.select(path.alias("path"), body.alias("page_content"))

    def web(entries):
        return documents.from_pages(pages).select("path", "page_content", "title")

    good, failed = pipeline.load_corpus(lists.unionByName(urls).unionByName(odd), {"json_entries": listed}, {"txt": texts, "url": web})
    shown = good.select("path", "filetype", "content_hash", "n_copies", "source_tag", "title", "tkn_length", F.lit(None).cast("string").alias("load_error"))
    return shown.unionByName(failed, allowMissingColumns=True)


@query("library_fanout", """
WITH i AS (SELECT o_orderkey::VARCHAR AS key, 'Order ' || o_orderkey AS title, 'Title: Order ' || o_orderkey || chr(10) || 'Date: ' || o_orderdate AS header,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS abstract FROM orders),
c AS (SELECT l_orderkey::VARCHAR AS key, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS child_key, l_returnflag AS rf, l_linestatus AS ls,
    l_partkey, l_linenumber FROM lineitem)
SELECT key, NULL AS child_key, 'metadata' AS branch, title || ' (metadata)' AS title, 'txt' AS filetype, NULL AS path,
  header || CASE WHEN abstract <> '' THEN chr(10) || chr(10) || 'Abstract:' || chr(10) || abstract ELSE '' END AS content FROM i
UNION ALL SELECT key, child_key, CASE WHEN ls = 'O' THEN 'fulltext' ELSE 'file' END, 'Part ' || l_partkey, CASE WHEN ls = 'O' THEN 'txt' ELSE 'pdf' END,
  CASE WHEN ls <> 'O' THEN 'store/' || l_partkey || '.pdf' END, CASE WHEN ls = 'O' THEN header || chr(10) || chr(10) || 'body ' || l_partkey END
  FROM c JOIN i USING (key) WHERE rf <> 'N'
UNION ALL SELECT key, child_key, 'note', title || ' (note)', 'txt', NULL, header || chr(10) || chr(10) || 'Note:' || chr(10) || 'note ' || l_linenumber
  FROM c JOIN i USING (key) WHERE rf = 'N'""")
def library_fanout(spark, sf):
    from corpusmill.sources.headers import labelled_lines

    title = F.concat(F.lit("Order "), "o_orderkey")
    items = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), title.alias("title"),
        labelled_lines({"Title": title, "Authors": F.lit(""), "Date": F.col("o_orderdate").cast("string")}).alias("header"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("abstract"))
    is_note = F.col("l_returnflag") == "N"
    part = F.col("l_partkey").cast("string")
    place = library.attachment_place(F.lit("imported_file"), F.lit("application/pdf"), F.concat(F.lit("store/"), part, F.lit(".pdf")), F.lit(None).cast("string"))
    children = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("parent_key"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("child_key"),
        F.when(is_note, "note").otherwise("attachment").alias("item_type"), F.concat(F.lit("Part "), part).alias("title"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("body "), part)).alias("fulltext"), place["filetype"].alias("filetype"),
        place["path"].alias("path"), F.concat(F.lit("note "), F.col("l_linenumber").cast("string")).alias("note"))
    return library.fan_out(items, children, "hybrid", include_notes=True)


@query("bookmark_artifact", """
WITH b AS (SELECT doc_id, doc_id % 6 AS k, lang, source, CASE WHEN length(text) > 400 THEN text ELSE '' END AS t FROM documents),
h AS (SELECT *, 'Title: ' || source || chr(10) || 'Note: ' || lang || chr(10) || chr(10) AS head FROM b)
SELECT doc_id, CASE k WHEN 0 THEN CASE WHEN t <> '' THEN 'txt' END WHEN 1 THEN CASE WHEN t <> '' THEN 'txt' ELSE 'pdf' END WHEN 2 THEN CASE WHEN lang <> 'de' THEN 'pdf' END
    WHEN 3 THEN CASE WHEN t <> '' THEN 'local_html' ELSE 'pdf' END WHEN 4 THEN 'pdf' ELSE CASE WHEN t <> '' THEN 'local_html' END END AS filetype,
  CASE WHEN k IN (0, 1, 3, 5) AND t <> '' THEN head || t END AS content,
  CASE WHEN (k = 2 AND lang <> 'de') OR k = 4 OR (k IN (1, 3) AND t = '') THEN CASE k WHEN 4 THEN 'arch' ELSE 'a' || doc_id END END AS asset_id FROM h""")
def bookmark_artifact(spark, sf):
    kind_no = F.pmod("doc_id", F.lit(6))
    kind = F.when(kind_no == 0, "text").when(kind_no <= 2, "asset").otherwise("link")
    body = F.when(F.length("text") > 400, F.col("text")).otherwise("")
    none = F.lit(None).cast("string")
    text = F.when(kind_no <= 1, body)
    html = F.when(F.col("doc_id") % 6 == 3, body).when(kind_no == 5, body)
    assets = F.when(kind_no == 4, F.array(F.struct(F.lit("shot").alias("id"), F.lit("screenshot").alias("assetType")),
                                          F.struct(F.lit("arch").alias("id"), F.lit("fullPageArchive").alias("assetType"))))
    own = F.when(kind_no.isin(1, 2, 3), F.concat(F.lit("a"), "doc_id"))
    stored = bookmarks.stored_asset(own, none, F.coalesce(assets, F.expr("cast(array() as array<struct<id:string,assetType:string>>)")))
    head = bookmarks.header({"title": F.col("source"), "content_title": none, "url": none, "source_url": none, "author": none,
                             "publisher": none, "date": none, "tags": F.expr("cast(array() as array<struct<name:string>>)"),
                             "note": F.col("lang"), "summary": F.lit(""), "id": none})
    docs = table(spark, sf, "documents").select("doc_id", bookmarks.artifact(
        kind, text, html, stored, head, asset_type=F.when((kind_no == 2) & (F.col("lang") == "de"), "image").otherwise("pdf")).alias("a"))
    return docs.select("doc_id", "a.filetype", "a.content", "a.asset_id")


@query("tree_subtree", """
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS key, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS key, 0 AS depth FROM region
  UNION ALL SELECT w.root, e.key, w.depth + 1 FROM w JOIN e ON e.parent = w.key)
SELECT root, key, depth FROM w""")
def tree_subtree(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionByName(
        customer.select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))
    roots = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"))
    return descendants(edges, roots)
