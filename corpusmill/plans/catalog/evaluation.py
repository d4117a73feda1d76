"""Judging, numbering and combining answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.functions.answers import keeps, mean_vote
from corpusmill.operators import batching, models
from corpusmill.operators import search as S
from corpusmill.operators.lineage import checkpointed
from corpusmill.plans import query as Q
from corpusmill.plans.catalog.vectors import COS_SQL, corpus, questions, rounded
from corpusmill.registry import query, table

QUESTION = "Which of the words in this thin question are used by and for the author?"
WORDS_SQL = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}]+'), lambda w: w <> '')"


@query("eval_votes", "WITH " + r"""
q AS (SELECT list_distinct(""" + WORDS_SQL.format(t=f"'{QUESTION}'") + r""") AS qw),
d AS (SELECT doc_id, list_distinct(""" + WORDS_SQL.format(t="text") + r""") AS dw FROM documents),
v AS (SELECT doc_id, list_transform([1, 2, 3], lambda n: CAST(floor(10 * len(list_intersect(list_filter(qw, lambda w: length(w) > n), dw))
    / len(list_filter(qw, lambda w: length(w) > n))) AS INTEGER)) AS votes FROM d, q)
SELECT doc_id, array_to_string(votes, ',') AS votes, list_sum(votes) / 3 >= 3 AS keep FROM v""")
def eval_votes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", models.overlap_votes(F.lit(QUESTION), F.col("text")).alias("v"))
    return docs.select("doc_id", F.array_join(F.col("v").cast("array<string>"), ",").alias("votes"), keeps(F.col("v")).alias("keep"))


@query("eval_filter", """
SELECT doc_id, round((coalesce(quality * 6, 5) + coalesce(5 - 5 * toxic, 5)) / 2, 6) AS mean_vote FROM documents LEFT JOIN labels USING (doc_id)
WHERE (coalesce(quality * 6, 5) + coalesce(5 - 5 * toxic, 5)) / 2 >= 3""")
def eval_filter(spark, sf):
    judged = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    votes = F.array((F.col("quality") * 6).cast("int"), (5 - 5 * F.col("toxic")).cast("int"))
    return (judged.withColumn("votes", votes).filter(keeps(F.col("votes")))
            .select("doc_id", F.round(mean_vote(F.col("votes")), 6).alias("mean_vote")))


JUDGED_SQL = COS_SQL + """,
judged AS (SELECT query_id, chunk_id, rank, cos, CASE WHEN quality IS NULL THEN 5 WHEN quality = 1 THEN 8 ELSE 1 END >= 3 AS keep
  FROM ranked LEFT JOIN labels ON doc_id = chunk_id WHERE rank <= 100 AND cos >= 0),
sizes AS (SELECT query_id, unnest([20, 30, 45, 67, 100]) AS k FROM (SELECT DISTINCT query_id FROM judged)),
counts AS (SELECT s.query_id, s.k, count(*) FILTER (WHERE keep AND rank <= s.k) AS n FROM sizes s JOIN judged j USING (query_id) GROUP BY s.query_id, s.k),
chosen AS (SELECT query_id, min(k) AS top_k, arg_min(n, k) AS n_kept FROM counts WHERE k = 100 OR n / k < 0.9 GROUP BY query_id)"""


def judged(spark, sf):
    hits = S.search(corpus(spark, sf), questions(spark, sf), 100)
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "chunk_id")
    vote = F.when(F.col("quality") == 1, 8).when(F.col("quality") == 0, 1)
    return hits.join(labels, "chunk_id", "left").withColumn("keep", keeps(F.array(vote)))


@query("adaptive_topk", "WITH " + JUDGED_SQL + "SELECT query_id, top_k, n_kept FROM chosen")
def adaptive_topk(spark, sf):
    return Q.adaptive_cut(judged(spark, sf), "auto_20_100").select("query_id", "top_k", "n_kept")


@query("topk_ratio", "WITH " + JUDGED_SQL + "SELECT query_id, round(n_kept / top_k, 6) AS kept_ratio FROM chosen")
def topk_ratio(spark, sf):
    return rounded(Q.adaptive_cut(judged(spark, sf), "auto_20_100").select("query_id", "kept_ratio"), "kept_ratio")


@query("collate", r"""
WITH d AS (SELECT conv_id, turn // 3 AS part, turn, regexp_replace(replace(replace('- • ' || text, '- • ', '- '), '• ', '- '), '^\s+', '') AS line FROM conversations)
SELECT conv_id, part, string_agg(line, chr(10) ORDER BY turn) AS answers FROM d GROUP BY conv_id, part""")
def collate(spark, sf):
    answers = table(spark, sf, "conversations").select(
        "conv_id", F.floor(F.col("turn") / 3).alias("part"), "turn", F.concat(F.lit("- • "), "text").alias("answer"))
    batches = answers.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "answer"))).alias("a"))
    return batches.select("conv_id", "part", Q.join_answers(F.transform("a", lambda s: s["answer"])).alias("answers"))


NUMBERED_SQL = COS_SQL + """,
hits AS (SELECT query_id, chunk_id, rank, CASE WHEN chunk_id % 5 = 0 THEN '<answer>IRRELEVANT</answer>' ELSE 'answer from ' || chunk_id END AS answer
  FROM ranked WHERE rank <= 30 AND cos >= 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_no FROM hits WHERE chunk_id % 5 <> 0)"""


def numbered(spark, sf):
    hits = S.search(corpus(spark, sf), questions(spark, sf), 30)
    answer = F.when(F.pmod("chunk_id", F.lit(5)) == 0, F.lit("<answer>IRRELEVANT</answer>")).otherwise(F.concat(F.lit("answer from "), "chunk_id"))
    return hits, answer, Q.numbered_answers(hits, answer)


@query("wrap_sources", "WITH " + NUMBERED_SQL + """
SELECT query_id, source_no, '<doc id=[[DOC_' || source_no || ']]>' || chr(10) || answer || chr(10) || '</doc>' AS wrapped FROM numbered""")
def wrap_sources(spark, sf):
    return numbered(spark, sf)[2].select("query_id", "source_no", "wrapped")


@query("missing_sources", "WITH " + NUMBERED_SQL + """
SELECT query_id, string_agg(source_no::VARCHAR, ',' ORDER BY source_no) FILTER (WHERE source_no % 3 <> 0
    AND NOT EXISTS (SELECT 1 FROM numbered o WHERE o.query_id = n.query_id AND o.source_no % 3 = 0 AND starts_with(o.source_no::VARCHAR, n.source_no::VARCHAR))) AS missing
FROM numbered n GROUP BY query_id""")
def missing_sources(spark, sf):
    # the final answer only names every third source
    found = numbered(spark, sf)[2]
    ids = F.array_sort(F.collect_list("source_no"))
    final = found.groupBy("query_id").agg(ids.alias("ids"))
    named = F.array_join(F.transform(F.filter("ids", lambda n: n % 3 == 0), lambda n: F.concat(F.lit("DOC_"), n.cast("string"))), " ")
    missing = F.filter("ids", lambda n: ~F.contains(F.col("named"), F.concat(F.lit("DOC_"), n.cast("string"))))
    return final.withColumn("named", named).select("query_id", F.nullif(F.array_join(missing.cast("array<string>"), ","), F.lit("")).alias("missing"))


@query("answer_each", "WITH " + COS_SQL + r""",
asked AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) > 1) AS ws FROM benchmark),
said AS (SELECT query_id, chunk_id, ws, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss
  FROM ranked JOIN documents ON doc_id = chunk_id JOIN asked ON item_id = query_id WHERE rank <= 30 AND cos >= 0)
SELECT query_id, chunk_id, coalesce(substr(list_filter(ss, lambda s: list_has_any(regexp_split_to_array(lower(s), '[^\p{L}]+'), ws))[1], 1, 16000),
  '<answer>IRRELEVANT</answer>') AS answer FROM said""")
def answer_each(spark, sf):
    hits = S.search(corpus(spark, sf), questions(spark, sf), 30)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    with_text = S.hits_with(checkpointed(hits), docs, "chunk_id").join(asked, "query_id")
    return with_text.select("query_id", "chunk_id", models.first_sentence_answer(F.col("question"), F.col("text")).alias("answer"))


@query("tree_reduce", "WITH " + NUMBERED_SQL + """
SELECT query_id, string_agg(source_no::VARCHAR, ',' ORDER BY source_no) AS sources, '' AS missing,
  string_agg('answer from ' || chunk_id, '|' ORDER BY 'answer from ' || chunk_id) AS parts FROM numbered GROUP BY query_id""")
def tree_reduce(spark, sf):
    hits, answer, _ = numbered(spark, sf)
    final = Q.answer_questions(hits, answer, models.hash_embedding)
    linked = F.regexp_extract_all("answer", F.lit(r"#document-(\d+)"), F.lit(1))
    parts = F.array_sort(F.regexp_extract_all("answer", F.lit(r"(answer from \d+)"), F.lit(1)))
    return final.select("query_id", F.array_join(F.array_sort(F.array_distinct(linked.cast("array<int>"))).cast("array<string>"), ",").alias("sources"),
                        F.array_join(F.col("missing_sources").cast("array<string>"), ",").alias("missing"),
                        F.array_join(parts, "|").alias("parts"))


def groups(spark, sf, k):
    """The nearest documents of each question, with their size and vector."""
    stored = corpus(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), text.est_tokens(F.col("text")).alias("tokens"))
    hits = checkpointed(S.search(stored, questions(spark, sf), k).select("query_id", "chunk_id"))
    sized = checkpointed(S.hits_with(hits, docs, "chunk_id"))
    return S.hits_with(sized, stored.select("chunk_id", "embedding"), "chunk_id")


@query("semantic_batches")
def semantic_batches(spark, sf):
    return batching.semantic_batches(groups(spark, sf, 60), ["query_id"], "chunk_id")


PAIRS_SQL = COS_SQL + """,
g AS (SELECT query_id, chunk_id, embedding FROM ranked JOIN embeddings ON vec_id = chunk_id JOIN documents ON doc_id = chunk_id WHERE rank <= 40 AND cos >= 0),
p AS (SELECT a.query_id, a.chunk_id, b.chunk_id AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM g a JOIN g b ON a.query_id = b.query_id AND a.chunk_id <> b.chunk_id)"""


@query("pairwise_distance", "WITH " + PAIRS_SQL + """
SELECT query_id, chunk_id, arg_min(other, d) AS other_id, round(min(d), 6) AS nearest, round(avg(d), 6) AS mean_distance FROM p GROUP BY query_id, chunk_id""")
def pairwise_distance(spark, sf):
    found = batching.group_distances(groups(spark, sf, 40), ["query_id"], "chunk_id").drop("leaf_rank")
    return rounded(found, "nearest", "mean_distance")


@query("leaf_order")
def leaf_order(spark, sf):
    return batching.group_distances(groups(spark, sf, 40), ["query_id"], "chunk_id").select("query_id", "chunk_id", "leaf_rank")


@query("embed_hash")
def embed_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", models.hash_embedding(F.col("text")).alias("e"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return docs.select("doc_id", F.size("e").alias("width"), F.round(size, 6).alias("length"))


FLAGSHIP_SQL = "WITH " + COS_SQL.replace("FROM embeddings, q)", """FROM embeddings JOIN documents ON doc_id = vec_id, q
  WHERE regexp_matches(text, '(?i)^(?:.*)') AND NOT regexp_matches(text, '^(?:The|Las)'))""") + """,
judged AS (SELECT r.*, coalesce(CASE quality WHEN 1 THEN 8 WHEN 0 THEN 1 END, 5) AS vote FROM ranked r LEFT JOIN labels ON doc_id = chunk_id WHERE rank <= 50 AND cos >= 0),
sizes AS (SELECT query_id, unnest([20, 30, 45, 50]) AS k FROM (SELECT DISTINCT query_id FROM judged)),
counts AS (SELECT s.query_id, s.k, count(*) FILTER (WHERE vote >= 3 AND rank <= s.k) AS n FROM sizes s JOIN judged j USING (query_id) GROUP BY s.query_id, s.k),
chosen AS (SELECT query_id, min(k) AS top_k FROM counts WHERE k = 50 OR n / k < 0.9 GROUP BY query_id)
SELECT query_id, chunk_id, rank, round(cos - 0.5, 6) AS score, vote::DOUBLE AS mean_vote, n_chars FROM judged JOIN chosen USING (query_id) JOIN documents ON doc_id = chunk_id
WHERE vote >= 3 AND rank <= top_k"""


@query("search_docs", FLAGSHIP_SQL)
def search_docs(spark, sf):
    from corpusmill.operators.filters import filter_store

    docs = table(spark, sf, "documents")
    allowed = filter_store(docs, content_rules=["+.*", "-The|Las"], text="text").select(F.col("doc_id").alias("chunk_id"))
    vectors = corpus(spark, sf).join(allowed, "chunk_id", "left_semi")
    labels = table(spark, sf, "labels")
    chunks = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), "n_chars", "quality")

    def evaluate(_hits):
        return F.array(F.when(F.col("quality") == 1, 8).when(F.col("quality") == 0, 1))

    asked = questions(spark, sf)
    found = Q.search_docs(asked, vectors, chunks, evaluate, "auto_20_50")
    return rounded(found.select("query_id", "chunk_id", "rank", "score", mean_vote(F.col("votes")).alias("mean_vote"), "n_chars"), "score")
