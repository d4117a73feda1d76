"""Totals, gates, copies and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.functions.filetypes import infer_filetype
from corpusmill.operators import accounting, dedup, documents
from corpusmill.registry import query, table

TOKENS = "CAST(ceil(length(text) / 4.0) AS BIGINT)"


def sized(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", F.col("source").alias("path"), text.est_tokens(F.col("text")).alias("tkn_length"))


@query("tokens_per_path", f"""
SELECT source AS path, sum({TOKENS})::BIGINT AS tokens FROM documents GROUP BY source UNION ALL SELECT NULL, sum({TOKENS})::BIGINT FROM documents""")
def tokens_per_path(spark, sf):
    return accounting.tokens_per_path(sized(spark, sf))


@query("price_per_path", f"""
SELECT source AS path, sum({TOKENS})::BIGINT AS tokens, round(sum({TOKENS}) * (0.002 * 4 + 0.006) / 5, 6) AS price FROM documents GROUP BY source""")
def price_per_path(spark, sf):
    totals = sized(spark, sf).groupBy("path").agg(F.sum("tkn_length").alias("tokens"))
    return totals.withColumn("price", F.round(accounting.display_price(F.col("tokens"), 0.002, 0.006), 6))


@query("summary_cost", f"""
WITH t AS (SELECT source AS path, sum({TOKENS})::DOUBLE AS n FROM documents GROUP BY source)
SELECT path, round((1000 + n) * 0.002 + n * 0.28 * 0.006
  + (1000 + n) * 0.002 + n * 0.28 * 0.006 + (1000 + n) * 0.28 * 0.002 + n * 0.28 * 0.28 * 0.006, 6) AS cost FROM t""")
def summary_cost(spark, sf):
    totals = sized(spark, sf).groupBy("path").agg(F.sum("tkn_length").alias("tokens"))
    return totals.select("path", F.round(accounting.summary_cost(F.col("tokens"), 0.002, 0.006, 2), 6).alias("cost"))


@query("tag_success_rate", """
SELECT source AS tag, count(*) FILTER (WHERE quality = 1) AS n_ok, count(*) FILTER (WHERE quality = 0) AS n_failed,
  round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 6) AS success_rate FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def tag_success_rate(spark, sf):
    loaded = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    counts = loaded.groupBy(F.col("source").alias("tag")).agg(
        F.count_if(F.col("quality") == 1).alias("n_ok"), F.count_if(F.col("quality") == 0).alias("n_failed"))
    rate = F.try_divide(F.lit(100.0) * F.col("n_ok"), F.col("n_ok") + F.col("n_failed"))
    return counts.withColumn("success_rate", F.round(rate, 6))


@query("dup_hashes", """
SELECT substr(sha256(text), 1, 20) AS content_hash, count(*) AS n_copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_hashes(spark, sf):
    docs = table(spark, sf, "documents").select(text.content_hash(F.col("text")).alias("content_hash"))
    return dedup.duplicate_hashes(docs)


@query("dedup_merge", """
WITH h AS (SELECT doc_id, lang, source, substr(sha256(text), 1, 20) AS content_hash FROM documents),
tags AS (SELECT content_hash, source, min(doc_id) AS t0 FROM h GROUP BY content_hash, source),
joined AS (SELECT content_hash, string_agg(source, ' ' ORDER BY t0) AS source_tag FROM tags GROUP BY content_hash),
notes AS (SELECT content_hash, min(doc_id) FILTER (WHERE doc_id % 3 = 0) AS noted FROM h GROUP BY content_hash)
SELECT content_hash, min(doc_id) AS doc_id, count(*) AS n_copies, any_value(source_tag) AS source_tag, arg_min(lang, doc_id) AS lang,
  'lang=' || arg_min(lang, doc_id) || coalesce('|note=n' || any_value(noted), '') AS metadata
FROM h JOIN joined USING (content_hash) JOIN notes USING (content_hash) GROUP BY content_hash""")
def dedup_merge(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", F.col("source").alias("source_tag"), text.content_hash(F.col("text")).alias("content_hash"),
        documents.metadata_map({"lang": F.col("lang"), "note": F.when(
            F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("n"), "doc_id"))}).alias("metadata"))
    merged = dedup.merge_copies(docs, "doc_id", metadata="metadata")
    shown = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return merged.withColumn("metadata", shown)


@query("first_per_key", """
SELECT source, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY source""")
def first_per_key(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang", "doc_id")
    return dedup.first_per_key(docs, ["source"], "doc_id")


@query("cluster_mean_tokens", f"""
WITH m AS (SELECT label, avg({TOKENS}) AS mean_tokens FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY label)
SELECT label, round(mean_tokens, 6) AS mean_tokens, round((SELECT avg(mean_tokens) FROM m), 6) AS mean_of_means FROM m""")
def cluster_mean_tokens(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    means = sized(spark, sf).join(labels, "doc_id").groupBy("label").agg(F.avg("tkn_length").alias("mean_tokens"))
    overall = means.agg(F.avg("mean_tokens")).scalar()
    return means.select("label", F.round("mean_tokens", 6).alias("mean_tokens"), F.round(overall, 6).alias("mean_of_means"))


@query("reading_total", """
SELECT source AS path, round(sum(round(length(text) / 6 / 250, 3)), 3) AS minutes FROM documents GROUP BY source""")
def reading_total(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("path"), text.doc_reading_time(F.col("text")).alias("m"))
    return docs.groupBy("path").agg(F.round(F.sum("m"), 3).alias("minutes"))


@query("usage_cost", f"""
WITH u AS (SELECT conv_id, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'completion' ELSE 'internal_reasoning' END AS kind,
  {TOKENS} AS tokens FROM conversations),
p AS (SELECT unnest(['prompt', 'completion', 'internal_reasoning']) AS kind, unnest([0.002, 0.006, 0.004])::DOUBLE AS price)
SELECT conv_id, sum(tokens)::BIGINT AS tokens, round(sum(tokens * price), 6) AS cost FROM u JOIN p USING (kind) GROUP BY conv_id""")
def usage_cost(spark, sf):
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "completion").otherwise("internal_reasoning")
    usage = table(spark, sf, "conversations").select("conv_id", kind.alias("kind"), text.est_tokens(F.col("text")).alias("tokens"))
    prices = spark.createDataFrame(list(zip(accounting.TOKEN_KINDS, (0.002, 0.006, 0.004), strict=True)), "kind string, price double")
    spent = accounting.usage_cost(usage, prices, ["conv_id"])
    return spent.withColumn("cost", F.round("cost", 6))


@query("multi_source", """
SELECT lang, count(DISTINCT source) AS n_sources, count(DISTINCT source) > 1 AS is_multi FROM documents GROUP BY lang""")
def multi_source(spark, sf):
    counted = table(spark, sf, "documents").groupBy("lang").agg(F.countDistinct("source").alias("n_sources"))
    return counted.withColumn("is_multi", F.col("n_sources") > 1)


VARIED_SQL = r"""
paths AS (SELECT page_id, CASE page_id % 16 WHEN 0 THEN '/m/youtube/' || page_id || '/playlist' WHEN 1 THEN 'https://youtu.be/' || page_id
  WHEN 2 THEN '/notes/logseq/p' || page_id || '.md' WHEN 3 THEN '/a/' || page_id || '.txt' WHEN 4 THEN url || '/x.pdf'
  WHEN 5 THEN '/a/' || page_id || '.pdf' WHEN 6 THEN '/a/' || page_id || '.html' WHEN 7 THEN '/a/' || page_id || '.mp3'
  WHEN 8 THEN '/a/' || page_id || '.epub' WHEN 9 THEN '/a/' || page_id || '.pptx' WHEN 10 THEN '/a/' || page_id || '.docx'
  WHEN 11 THEN '/a/' || page_id || '.mkv' WHEN 12 THEN '/a/' || page_id || '.json' WHEN 13 THEN '/a/' || page_id || '.toml'
  WHEN 14 THEN '/a/' || page_id ELSE url END AS path FROM pages),
typed AS (SELECT page_id, path, CASE
  WHEN regexp_matches(path, 'youtube.*playlist') THEN 'youtube_playlist' WHEN regexp_matches(path, 'youtube|invidi|youtu\.') THEN 'youtube'
  WHEN regexp_matches(path, '.*logseq.*.md') THEN 'logseq_markdown' WHEN regexp_matches(path, '.txt$|.md$') THEN 'txt'
  WHEN regexp_matches(path, '^http.*pdf.*') THEN 'online_pdf' WHEN regexp_matches(path, '.*pdf$') THEN 'pdf'
  WHEN regexp_matches(path, '^http') THEN 'url' WHEN regexp_matches(path, '\.html?$') THEN 'local_html'
  WHEN regexp_matches(path, '.*(mp3|m4a|ogg|flac)$') THEN 'local_audio' WHEN regexp_matches(path, '.epub$') THEN 'epub'
  WHEN regexp_matches(path, '.ppt$|.pptx$|.odp$') THEN 'powerpoint' WHEN regexp_matches(path, '.doc$|.docx$|.odt$') THEN 'word'
  WHEN regexp_matches(path, '.mp4|.avi|.mkv') THEN 'local_video' WHEN regexp_matches(path, '.*.json') THEN 'json_entries'
  WHEN regexp_matches(path, '.*.toml') THEN 'toml_entries' END AS filetype FROM paths)"""


def varied_paths(spark, sf):
    n, url, kind = F.col("page_id").cast("string"), F.col("url"), F.pmod("page_id", F.lit(16))
    shapes = [("/m/youtube/", n, "/playlist"), ("https://youtu.be/", n, ""), ("/notes/logseq/p", n, ".md"), ("/a/", n, ".txt"),
              ("", url, "/x.pdf"), ("/a/", n, ".pdf"), ("/a/", n, ".html"), ("/a/", n, ".mp3"), ("/a/", n, ".epub"),
              ("/a/", n, ".pptx"), ("/a/", n, ".docx"), ("/a/", n, ".mkv"), ("/a/", n, ".json"), ("/a/", n, ".toml"), ("/a/", n, ""),
              ("", url, "")]
    path = F.when(F.lit(False), F.lit(""))
    for i, (head, middle, tail) in enumerate(shapes):
        path = path.when(kind == i, F.concat(F.lit(head), middle, F.lit(tail)))
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


@query("infer_filetype", "WITH " + VARIED_SQL + " SELECT page_id, path, filetype FROM typed")
def infer_filetype_query(spark, sf):
    return varied_paths(spark, sf).withColumn("filetype", infer_filetype(F.col("path")))


@query("filetype_freq", "WITH " + VARIED_SQL + " SELECT filetype, count(*) AS n FROM typed GROUP BY filetype")
def filetype_freq(spark, sf):
    typed = varied_paths(spark, sf).select(infer_filetype(F.col("path")).alias("filetype"))
    return typed.groupBy("filetype").agg(F.count(F.lit(1)).alias("n"))


@query("pick_best_parse", """
WITH c AS (SELECT doc_id, round((doc_id % 7) / 10 + 0.3, 4)::DOUBLE AS p1, round((doc_id % 11) / 10, 4)::DOUBLE AS p2,
  round((doc_id % 5) / 5 + 0.18, 4)::DOUBLE AS p3, 0.77::DOUBLE AS p4 FROM documents),
l AS (SELECT doc_id, list_filter([{'name': 'a', 'i': 1, 'p': p1}, {'name': 'b', 'i': 2, 'p': p2}, {'name': 'c', 'i': 3, 'p': p3}, {'name': 'd', 'i': 4, 'p': p4}],
  lambda x: x.p >= 0.5) AS g FROM c),
k AS (SELECT doc_id, g[1:least(3, coalesce(list_min(list_transform(list_filter(range(1, len(g) + 1), lambda i: g[i].p > 0.95), lambda i: i)), 3))] AS g FROM l)
SELECT doc_id, list_filter(g, lambda x: x.p = list_max(list_transform(g, lambda y: y.p)))[1].name AS parser,
  round(list_max(list_transform(g, lambda y: y.p))::DOUBLE, 6) AS prob FROM k""")
def pick_best_parse(spark, sf):
    def part(n):
        return F.pmod("doc_id", F.lit(n))

    probs = {"a": part(7) / 10 + 0.3, "b": part(11) / 10, "c": part(5) / 5 + 0.18, "d": F.lit(0.77)}
    parses = F.array(*[F.struct(F.lit(name).alias("name"), F.col("text").alias("content"), F.round(prob, 4).alias("prob"))
                       for name, prob in probs.items()])
    best = table(spark, sf, "documents").select("doc_id", accounting.pick_best(parses).alias("b"))
    return best.select("doc_id", F.col("b.name").alias("parser"), F.round("b.prob", 6).alias("prob"))


@query("list_merge", """
SELECT source, string_agg(lang, ',' ORDER BY lang) AS langs FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source""")
def list_merge(spark, sf):
    pairs = table(spark, sf, "documents").select("source", "lang").distinct()
    return pairs.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("langs"))


@query("embed_cost", f"""
SELECT sum({TOKENS})::BIGINT AS tokens, round((sum({TOKENS}) * 0.00002)::DOUBLE, 6) AS cost, sum({TOKENS}) * 0.00002 > 5 AS over_limit FROM documents""")
def embed_cost(spark, sf):
    total = sized(spark, sf).agg(F.sum("tkn_length").alias("tokens"))
    cost = F.col("tokens") * 0.00002
    return total.select("tokens", F.round(cost, 6).alias("cost"), (cost > 5).alias("over_limit"))


GATE_SQL = f"""
g AS (SELECT source, lang, sum({TOKENS})::BIGINT AS tokens, sum(round(length(text) / 6 / 250, 3)) AS minutes, count(*) AS n_chunks
  FROM documents GROUP BY source, lang)"""


def chunked(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "source", "lang", F.col("text").alias("page_content"), text.est_tokens(F.col("text")).alias("tkn_length"),
        text.doc_reading_time(F.col("text")).alias("doc_reading_time"))


@query("size_gate", f"""
SELECT doc_id, {TOKENS} AS tokens, CASE WHEN {TOKENS} <= 20 THEN 'too few tokens' WHEN {TOKENS} >= 5000 THEN 'too many tokens'
  WHEN round(length(text) / 6 / 250, 3) <= 0.1 THEN 'too short to read' END AS load_error FROM documents""")
def size_gate(spark, sf):
    return documents.gate(chunked(spark, sf), ["doc_id"], max_tokens=5000).select("doc_id", "tokens", "load_error")


@query("reading_gate", "WITH " + GATE_SQL + """
SELECT source, lang, n_chunks, round(minutes, 3) AS minutes FROM g WHERE tokens > 20 AND round(minutes, 6) > 14.0""")
def reading_gate(spark, sf):
    # no most tokens: the groups are many files
    gated = documents.gate(chunked(spark, sf), ["source", "lang"], max_tokens=None, min_minutes=14.0)
    return gated.filter(F.col("load_error").isNull()).select("source", "lang", "n_chunks", F.round("minutes", 3).alias("minutes"))


LANGUAGE_SQL = r"""
w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, source, least(1.0, 5.0 * greatest(
  len(list_filter(ws, lambda x: list_contains(string_split('the of and to in is it that was for on are as with be by this', ' '), x))),
  len(list_filter(ws, lambda x: list_contains(string_split('le la les de des et en un une est que qui dans pour au du pas avec', ' '), x))),
  len(list_filter(ws, lambda x: list_contains(string_split('der die das und in den von zu mit ist nicht auf ein eine dem es', ' '), x))),
  len(list_filter(ws, lambda x: list_contains(string_split('el la los de que y en un una por con para las del se es no su', ' '), x)))
  ) / greatest(1, len(ws)))::DOUBLE AS prob FROM w)"""


@query("lang_prob", "WITH " + LANGUAGE_SQL + "SELECT doc_id, round(prob, 6) AS prob FROM p")
def lang_prob(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(documents.language_probability(F.col("text")), 6).alias("prob"))


@query("lang_gate", "WITH " + LANGUAGE_SQL + """
SELECT source, count(*) AS n_chunks, round(avg(prob), 6) AS language, CASE WHEN avg(prob) <= 0.5 THEN 'unlikely language' END AS load_error FROM p GROUP BY source""")
def lang_gate(spark, sf):
    # a source is no file: its size grows with the corpus and says nothing about its language
    gated = documents.gate(chunked(spark, sf), ["source"], min_tokens=None, max_tokens=None, min_minutes=None,
                           min_language=documents.MIN_LANGUAGE_PROBABILITY)
    return gated.select("source", "n_chunks", F.round("language", 6).alias("language"), "load_error")


@query("load_errors", f"""
SELECT '{{"doc_id":' || doc_id || ',"source":"' || source || '"}}' AS args,
  CASE WHEN doc_id % 7 = 0 THEN 'empty document' WHEN {TOKENS} <= 20 THEN 'too few tokens' ELSE 'too short to read' END AS load_error
FROM documents WHERE doc_id % 7 = 0 OR {TOKENS} <= 20 OR round(length(text) / 6 / 250, 3) <= 0.1""")
def load_errors(spark, sf):
    from corpusmill.sources.loading import with_load_errors

    docs = table(spark, sf, "documents").select(
        "doc_id", "source", F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit(" ")).otherwise(F.col("text")).alias("page_content"))
    failed = with_load_errors(docs).filter(F.col("load_error").isNotNull())
    return failed.select(F.to_json(F.struct("doc_id", "source")).alias("args"), "load_error").orderBy("args")


@query("pca_variance")
def pca_variance(spark, sf):
    from corpusmill.operators.reduction import explained_variance

    return explained_variance(table(spark, sf, "embeddings"), 32)
