"""Filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import content_hash
from corpusmill.operators import dedup, filters
from corpusmill.operators.documents import finish, metadata_map
from corpusmill.registry import query, table


def described(spark, sf):
    """Documents with a metadata map; the notes key only exists on part of them."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "text", metadata_map({
        "lang": F.col("lang"), "Source": F.col("source"),
        "note": F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("n"), "lang")),
    }).alias("metadata"))


@query("filter_content", r"""
SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)^(?:.*the)') AND NOT regexp_matches(text, '^(?:The|And)')""")
def filter_content(spark, sf):
    kept = filters.filter_store(table(spark, sf, "documents"), content_rules=["+.*the", "-The|And"], text="text")
    return kept.select("doc_id")


@query("path_include_exclude", r"""
SELECT page_id, url FROM pages WHERE (regexp_matches(url, '(?i)example\.com') OR regexp_matches(url, '(?i)/fr/'))
  AND NOT regexp_matches(url, '(?i)page=') AND NOT regexp_matches(url, '#Top')""")
def path_include_exclude(spark, sf):
    keep = filters.path_predicate(F.col("url"), [r"example\.com", "/fr/"], ["page=", "#Top"])
    return table(spark, sf, "pages").filter(keep).select("page_id", "url")


@query("filter_meta_key", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def filter_meta_key(spark, sf):
    return filters.filter_store(described(spark, sf), metadata_rules=["k+note"]).select("doc_id")


@query("filter_meta_value", "SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND source NOT LIKE 'src1%'")
def filter_meta_value(spark, sf):
    return filters.filter_store(described(spark, sf), metadata_rules=["v+e[ns]$", "v-src1"]).select("doc_id")


@query("filter_meta_both", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND lang IN ('fr', 'de') AND source LIKE 'src%1'")
def filter_meta_both(spark, sf):
    return filters.filter_store(described(spark, sf), metadata_rules=["b+note:n(fr|de)", "b+Source:src[0-9]?1$"], allow_empty=True).select("doc_id")


@query("filter_meta_both_neg", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND lang <> 'en'")
def filter_meta_both_neg(spark, sf):
    return filters.filter_store(described(spark, sf), metadata_rules=["b-note:nen"]).select("doc_id")


@query("meta_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events UNION SELECT unnest(['lang', 'Source', 'note'])")
def meta_keys(spark, sf):
    events = table(spark, sf, "events").select(F.from_json("props", "map<string,string>").alias("metadata"))
    return filters.metadata_keys(events.unionByName(described(spark, sf).select("metadata")))


@query("filter_stats", """
SELECT count(*) AS n_checked, count(*) FILTER (WHERE lang = 'fr') AS n_kept,
       round(count(*) FILTER (WHERE lang = 'fr') / count(*), 6) AS kept_ratio FROM documents""")
def filter_stats(spark, sf):
    keep = filters.metadata_predicate(["b+lang:fr"], F.col("metadata"))
    return described(spark, sf).agg(
        F.count(F.lit(1)).alias("n_checked"), F.count_if(keep).alias("n_kept"),
        F.round(F.count_if(keep) / F.count(F.lit(1)), 6).alias("kept_ratio"))


@query("drop_blank", "SELECT doc_id FROM documents WHERE doc_id % 7 > 1")
def drop_blank(spark, sf):
    kind = F.pmod("doc_id", F.lit(7))
    text = F.when(kind == 0, F.lit(" \t\n ")).when(kind == 1, F.lit(None)).otherwise(F.col("text"))
    chunks = table(spark, sf, "documents").select(
        "doc_id", text.alias("page_content"), F.expr("cast(map() as map<string,string>)").alias("metadata"))
    return finish(chunks, F.lit("none")).select("doc_id")


@query("zip_join", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def zip_join(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query("cards_notes", """
SELECT o_orderkey, l_linenumber, o_orderpriority, l_shipdate, round(l_quantity, 6) AS l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def cards_notes(spark, sf):
    notes, cards = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return (notes.join(cards, notes.o_orderkey == cards.l_orderkey)
            .select("o_orderkey", "l_linenumber", "o_orderpriority", "l_shipdate", F.round("l_quantity", 6).alias("l_quantity")))


@query("lookup_broadcast", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def lookup_broadcast(spark, sf):
    # no hint: the optimizer knows both sizes and ships the smaller side only below its threshold
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


@query("containment_join", """
SELECT d.doc_id, min(b.item_id) AS first_item, count(*) AS n_items FROM documents d JOIN benchmark b ON contains(d.text, b.text)
GROUP BY d.doc_id""")
def containment_join(spark, sf):
    from corpusmill.operators.containment import contained_in

    blocks = table(spark, sf, "benchmark").select(F.col("item_id").alias("block_id"), "text")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = contained_in(blocks, docs, "block_id", "doc_id")
    return found.groupBy("doc_id").agg(F.min("block_id").alias("first_item"), F.count(F.lit(1)).alias("n_items"))


@query("source_tag_audit", """
WITH ok AS (SELECT source AS tag, count(*) AS n_ok FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source),
bad AS (SELECT source AS tag, count(*) AS n_failed FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source),
asked AS (SELECT DISTINCT 'src' || (label * 3) AS tag FROM embeddings)
SELECT coalesce(a.tag, f.tag) AS tag, coalesce(n_ok, 0) AS n_ok, coalesce(n_failed, 0) AS n_failed,
  CASE WHEN a.tag IS NULL THEN 'extra' WHEN coalesce(n_ok, 0) = 0 THEN 'missing' ELSE 'ok' END AS state
FROM asked a FULL JOIN (SELECT tag, n_ok, n_failed FROM ok FULL JOIN bad USING (tag)) f ON a.tag = f.tag""")
def source_tag_audit(spark, sf):
    from corpusmill.operators.accounting import audit_tags

    asked = table(spark, sf, "embeddings").select(F.concat(F.lit("src"), F.col("label") * 3).alias("tag"))
    loaded = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return audit_tags(asked, loaded.select(F.col("source").alias("tag"), (F.col("quality") == 0).alias("failed")))


@query("cache_miss", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def cache_miss(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", dedup.reply_key(F.col("doc_id").cast("string"), F.lit("m")).alias("key"))
    stored = table(spark, sf, "labels").select(dedup.reply_key(F.col("doc_id").cast("string"), F.lit("m")).alias("key"))
    return dedup.cache_misses(docs, stored, "key").select("doc_id")


@query("cache_hit", "SELECT doc_id, quality AS value FROM documents JOIN labels USING (doc_id)")
def cache_hit(spark, sf):
    key = dedup.reply_key(F.col("doc_id").cast("string"), F.lit("m")).alias("key")
    docs = table(spark, sf, "documents").select("doc_id", key)
    stored = table(spark, sf, "labels").select(key, F.col("quality").alias("value"))
    return dedup.cache_hits(docs, stored, "key").select("doc_id", "value")


@query("cache_ttl", """
SELECT event_type, count(*) AS n_alive FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY GROUP BY event_type""")
def cache_ttl(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    alive = dedup.cache_alive(table(spark, sf, "events"), "ts", now, 10)
    return alive.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_alive"))


@query("distinct_texts", "SELECT DISTINCT substr(sha256(text), 1, 20) AS content_hash FROM documents")
def distinct_texts(spark, sf):
    return table(spark, sf, "documents").select(content_hash(F.col("text")).alias("content_hash")).distinct()


@query("arg_intersect", "SELECT lang AS name FROM documents INTERSECT SELECT unnest(['fr', 'de', 'zz'])")
def arg_intersect(spark, sf):
    forbidden = spark.range(1).select(F.explode(F.array(F.lit("fr"), F.lit("de"), F.lit("zz"))).alias("name"))
    return table(spark, sf, "documents").select(F.col("lang").alias("name")).intersect(forbidden)


@query("extra_tags", "SELECT source AS tag FROM documents EXCEPT SELECT 'src' || label FROM embeddings")
def extra_tags(spark, sf):
    asked = table(spark, sf, "embeddings").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("tag"))
    return table(spark, sf, "documents").select(F.col("source").alias("tag")).subtract(asked)


@query("subtag", """
WITH tags AS (SELECT DISTINCT p_name AS tag FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part)
SELECT tag, EXISTS (SELECT 1 FROM tags o WHERE o.tag <> t.tag AND contains(o.tag, t.tag)) AS is_sub FROM tags t""")
def subtag(spark, sf):
    from corpusmill.operators.containment import mark_subtags

    parts = table(spark, sf, "part")
    tags = (parts.select(F.col("p_name").alias("tag"))
            .unionByName(parts.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("tag")))
            .unionByName(parts.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("tag"))).distinct())
    return mark_subtags(tags)


@query("name_lookup", "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON n_name = 'NATION_' || c_nationkey")
def name_lookup(spark, sf):
    from corpusmill.sources.bookmarks import ids_of_names

    wanted = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("NATION_"), "c_nationkey").alias("name"))
    known = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return ids_of_names(wanted, known).select("c_custkey", F.col("id").alias("n_nationkey"))


@query("fuzzy_name", """
WITH names AS (SELECT DISTINCT p_name AS name FROM part),
asked AS (SELECT p_brand, unnest([p_name, substr(p_name, 1, length(p_name) - 1), substr(p_name, 1, length(p_name) - 1) || 'x', substr(p_name, 1, 2),
  'zz' || p_name, reverse(p_name)]) AS wanted FROM part),
d AS (SELECT p_brand, wanted, name, levenshtein(wanted, name) AS dist, starts_with(name, wanted) AS starts FROM (SELECT DISTINCT * FROM asked), names)
SELECT p_brand, wanted, CASE WHEN bool_or(name = wanted) THEN wanted WHEN count(*) FILTER (WHERE starts) = 1 THEN min(name) FILTER (WHERE starts)
  ELSE arg_min(name, (dist, name)) END AS name FROM d GROUP BY p_brand, wanted""")
def fuzzy_name(spark, sf):
    """Names as they are, cut short, misspelt at their end or beginning, and turned round."""
    from corpusmill.operators.names import closest_names

    parts = table(spark, sf, "part")
    shorter = F.expr("substring(p_name, 1, length(p_name) - 1)")
    variants = F.array("p_name", shorter, F.concat(shorter, F.lit("x")), F.substr("p_name", F.lit(1), F.lit(2)),
                       F.concat(F.lit("zz"), "p_name"), F.reverse("p_name"))
    wanted = parts.select("p_brand", F.explode(variants).alias("wanted")).distinct()
    return closest_names(wanted, parts.select(F.col("p_name").alias("name")).distinct())


@query("note_ids", """
SELECT DISTINCT trim(unnest(string_split(concat_ws(' ', doc_id // 3, doc_id // 5, doc_id // 7), ' '))) AS note_id FROM documents""")
def note_ids(spark, sf):
    ids = F.concat_ws(" ", *[F.floor(F.col("doc_id") / n).cast("string") for n in (3, 5, 7)])
    return table(spark, sf, "documents").select(F.explode(F.split(ids, " ")).alias("note_id")).distinct()
