"""Vector search, retrievers and the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.functions.let import let
from corpusmill.functions.numbers import round_scaled
from corpusmill.operators import batching, retrieval, similar, store
from corpusmill.operators import search as S
from corpusmill.operators.lineage import checkpointed
from corpusmill.registry import query, table

MEANS_SQL = """
q AS (SELECT label AS query_id, list(m ORDER BY pos) AS qv FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos)
  GROUP BY label)"""
COS_SQL = MEANS_SQL + """,
cosines AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], qv) AS cos FROM embeddings, q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, chunk_id) AS rank FROM cosines)"""
BITS_SQL = """
d AS (SELECT query_id, vec_id AS chunk_id, list_sum(list_transform(range(1, 65), lambda i:
    CASE WHEN (embedding[i] > 1e-10) <> (qv[i] > 1e-10) THEN 1 ELSE 0 END))::INTEGER AS distance FROM embeddings, q),
byhamming AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d)"""


def corpus(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def questions(spark, sf):
    """One question per topic: the mean vector of its label."""
    return retrieval.mean_vectors(table(spark, sf, "embeddings"), ["label"]).withColumnRenamed("label", "query_id")


def rounded(df, *columns):
    return df.select([round_scaled(F.col(c), 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("knn_cosine", "WITH " + COS_SQL + """
SELECT query_id, chunk_id, rank, round(cos - 0.5, 6) AS score FROM ranked WHERE rank <= 100 AND cos >= 0""")
def knn_cosine(spark, sf):
    hits = S.search(corpus(spark, sf), questions(spark, sf), 100)
    return rounded(hits.select("query_id", "chunk_id", "rank", "score"), "score")


@query("knn_l2", "WITH " + COS_SQL + """
SELECT query_id, chunk_id, rank, round(2 - 2 * cos, 6) AS distance FROM ranked WHERE rank <= 100""")
def knn_l2(spark, sf):
    unit_c = store.build(corpus(spark, sf))
    unit_q = store.build(questions(spark, sf))
    hits = S.nearest(unit_c, unit_q, 100, "l2")
    return rounded(hits.select("query_id", "chunk_id", "rank", "distance"), "distance")


@query("score_threshold", "WITH " + COS_SQL + """
SELECT query_id, count(*) AS n_hits, round(min(cos) - 0.5, 6) AS worst FROM ranked WHERE rank <= 200 AND cos - 0.5 >= -0.3 GROUP BY query_id""")
def score_threshold(spark, sf):
    hits = S.search(corpus(spark, sf), questions(spark, sf), 200, threshold=-0.3)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.min("score"), 6).alias("worst"))


@query("knn_small", "WITH " + MEANS_SQL + """
SELECT query_id, (SELECT count(*) FROM q) AS n_hits, (SELECT count(*) FROM q) AS last_rank FROM q""")
def knn_small(spark, sf):
    # the topics searched among themselves: fewer rows than asked for
    asked = questions(spark, sf)
    hits = S.search(asked.withColumnRenamed("query_id", "chunk_id"), asked, 500, threshold=None)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("rank").cast("bigint").alias("last_rank"))


@query("score_fn", """
SELECT vec_id, round(1 - (1 + (2 - 2 * list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 8)) / 2, 6) AS score FROM embeddings""")
def score_fn(spark, sf):
    # squared distance to the unit vector with all 64 components alike, whose dot product is sum / 8
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(V.score_from_squared_l2(2 - 2 * total / 8), 6).alias("score"))


@query("l2_normalise", """
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS v FROM embeddings),
m AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM n)
SELECT vec_id, round(len, 6) AS len, round(v[1] / len, 6) AS first, round(v[64] / len, 6) AS last FROM m""")
def l2_normalise(spark, sf):
    stretched = table(spark, sf, "embeddings").select("vec_id", F.transform(
        "embedding", lambda x: x.cast("double") * (1 + F.pmod("vec_id", F.lit(7)))).alias("v"))
    unit = stretched.select("vec_id", V.norm(F.col("v")).alias("len"), V.l2_normalise(F.col("v")).alias("u"))
    return rounded(unit.select("vec_id", "len", F.col("u")[0].alias("first"), F.col("u")[63].alias("last")),
                   "len", "first", "last")


@query("binarise", """
SELECT vec_id, CAST(CAST(list_sum(list_transform(range(2, 65), lambda i: CASE WHEN embedding[i] > 1e-10
    THEN (1::HUGEINT << (64 - i)::HUGEINT) ELSE 0::HUGEINT END)) - CASE WHEN embedding[1] > 1e-10
    THEN 9223372036854775808::HUGEINT ELSE 0::HUGEINT END AS BIGINT) AS VARCHAR) AS words FROM embeddings""")
def binarise(spark, sf):
    bits = store.build(table(spark, sf, "embeddings"), "binary")
    return bits.select("vec_id", F.array_join(F.col("bits").cast("array<string>"), ",").alias("words"))


@query("knn_hamming", "WITH " + MEANS_SQL + "," + BITS_SQL + """
SELECT query_id, chunk_id, rank, distance FROM byhamming WHERE rank <= 50 AND distance <= 30""")
def knn_hamming(spark, sf):
    hits = S.search_bits(corpus(spark, sf), questions(spark, sf), 50, 64, max_distance=30)
    return hits.select("query_id", "chunk_id", "rank", F.col("distance").cast("int").alias("distance"))


@query("hamming_score", "WITH " + MEANS_SQL + "," + BITS_SQL + """
SELECT query_id, chunk_id, round(1 - least(distance / 64, 1.0), 6) AS score FROM byhamming WHERE rank <= 50""")
def hamming_score(spark, sf):
    hits = S.search_bits(corpus(spark, sf), questions(spark, sf), 50, 64)
    return rounded(hits.select("query_id", "chunk_id", "score"), "score")


@query("filtered_knn", "WITH " + COS_SQL + """,
kept AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY r.rank) AS final
  FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 120 AND d.lang <> 'en')
SELECT query_id, chunk_id, final AS rank, round(cos - 0.5, 6) AS score FROM kept WHERE final <= 15""")
def filtered_knn(spark, sf):
    allowed = table(spark, sf, "documents").filter("lang <> 'en'").select(F.col("doc_id").alias("chunk_id"))
    hits = S.search_filtered(corpus(spark, sf), questions(spark, sf), allowed, k=15, fetch_k=120)
    return rounded(hits.select("query_id", "chunk_id", "rank", "score"), "score")


@query("knn_minmax", "WITH " + COS_SQL + """,
ext AS (SELECT query_id, min(cos) AS lo, max(cos) AS hi FROM cosines GROUP BY query_id)
SELECT query_id, chunk_id, rank, round((cos - lo) / (hi - lo + 1e-6), 6) AS score FROM ranked JOIN ext USING (query_id)
WHERE rank <= 40 AND (cos - lo) / (hi - lo + 1e-6) >= 0.8""")
def knn_minmax(spark, sf):
    return rounded(S.minmax_hits(corpus(spark, sf), questions(spark, sf), 40, 0.8), "score")


@query("multiquery", """
WITH q AS (SELECT label AS query_id, part, list(m ORDER BY pos) AS qv FROM (
    SELECT label, part, pos, avg(x) AS m FROM (
      SELECT label, vec_id % 4 AS part, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, part, pos) GROUP BY label, part),
r AS (SELECT query_id, part, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], qv) AS cos FROM embeddings, q),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY cos DESC, chunk_id) AS rank FROM r)
SELECT query_id, chunk_id, min(rank) AS best_rank, round(max(cos) - 0.5, 6) AS score FROM k
WHERE rank <= 30 AND cos >= 0 GROUP BY query_id, chunk_id""")
def multiquery(spark, sf):
    parts = table(spark, sf, "embeddings").withColumn("subquery_id", F.pmod("vec_id", F.lit(4)))
    rephrased = retrieval.mean_vectors(parts, ["label", "subquery_id"]).withColumnRenamed("label", "query_id")
    hits = retrieval.multi_query(corpus(spark, sf), rephrased, 30)
    return rounded(hits.withColumn("best_rank", F.col("best_rank").cast("bigint")), "score")


@query("parent_retrieve", "WITH " + COS_SQL + """
SELECT query_id, chunk_id // 4 AS parent_id, min(rank) AS best_rank, count(*) AS n_children FROM ranked
WHERE rank <= 60 AND cos >= 0 GROUP BY ALL""")
def parent_retrieve(spark, sf):
    stored = corpus(spark, sf)
    children = stored.select("chunk_id", F.floor(F.col("chunk_id") / 4).alias("parent_id"))
    found = retrieval.parents_of(S.search(stored, questions(spark, sf), 60), children)
    return found.withColumn("best_rank", F.col("best_rank").cast("bigint"))


MERGED_SQL = COS_SQL + "," + BITS_SQL + """,
pooled AS (SELECT query_id, chunk_id, rank, 0 AS retriever FROM ranked WHERE rank <= 40 AND cos >= 0
         UNION ALL SELECT query_id, chunk_id, rank, 1 FROM byhamming WHERE rank <= 40),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, retriever) AS seen FROM pooled)"""


def merged(spark, sf):
    stored, asked = corpus(spark, sf), questions(spark, sf)
    return retrieval.merge([S.search(stored, asked, 40), S.search_bits(stored, asked, 40, 64)])


@query("merge_retrievers", "WITH " + MERGED_SQL + "SELECT query_id, chunk_id, rank, retriever FROM firsts WHERE seen = 1")
def merge_retrievers(spark, sf):
    return merged(spark, sf)


@query("sieve", "WITH " + MERGED_SQL + """
SELECT query_id, chunk_id, pos FROM (SELECT query_id, chunk_id,
    row_number() OVER (PARTITION BY query_id ORDER BY rank, retriever, chunk_id) AS pos FROM firsts WHERE seen = 1) WHERE pos <= 25""")
def sieve(spark, sf):
    return retrieval.sieve(merged(spark, sf), 25).select("query_id", "chunk_id", "pos")


@query("redundant_filter", """
WITH twice AS (SELECT vec_id AS chunk_id, label, embedding FROM embeddings
  UNION ALL SELECT vec_id + 1000000, label, list_transform(embedding, lambda x: (x * 2)::FLOAT) FROM embeddings
  UNION ALL SELECT vec_id + 2000000, label, list_transform(embedding, lambda x: x + (CASE WHEN vec_id % 2 = 0 THEN 0.002 ELSE 0.02 END)::FLOAT) FROM embeddings
  UNION ALL SELECT vec_id + 3000000, label, list_transform(range(1, 65), lambda i: (f[i]::DOUBLE + 0.03 * embedding[i]::DOUBLE)::FLOAT) FROM embeddings, (SELECT arg_min(embedding, vec_id) AS f FROM embeddings)
  UNION ALL SELECT vec_id + 4000000, label, list_transform(range(1, 65), lambda i: (f[i]::DOUBLE + 0.01 * embedding[i]::DOUBLE)::FLOAT) FROM embeddings, (SELECT arg_min(embedding, vec_id) AS f FROM embeddings)),
pairs AS (SELECT DISTINCT a.chunk_id FROM twice a JOIN twice b ON a.label = b.label AND b.chunk_id < a.chunk_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.999)
SELECT chunk_id, label FROM twice WHERE chunk_id NOT IN (SELECT chunk_id FROM pairs)""")
def redundant_filter(spark, sf):
    stored = corpus(spark, sf)
    doubled = stored.withColumns({"chunk_id": F.col("chunk_id") + 1_000_000,
                                  "embedding": F.transform("embedding", lambda x: (x * 2).cast("float"))})
    shifted = stored.withColumns({"chunk_id": F.col("chunk_id") + 2_000_000,
                                  "embedding": F.transform("embedding", lambda x: x + F.when(
                                      F.pmod("chunk_id", F.lit(2)) == 0, 0.002).otherwise(0.02).cast("float"))})
    # two rows in five lie close to one vector: a hot cell of the grid
    first = F.array(*(F.lit(float(x)) for x in stored.agg(F.min_by("embedding", "chunk_id")).first()[0]))

    def around_first(add, noise):
        moved = F.zip_with(first, "embedding", lambda a, x: (a + noise * x.cast("double")).cast("float"))
        return stored.select((F.col("chunk_id") + add).alias("chunk_id"), moved.alias("embedding"), "label")

    hot = [around_first(3_000_000, 0.03), around_first(4_000_000, 0.01)]
    everything = stored.unionByName(doubled).unionByName(shifted).unionByName(hot[0]).unionByName(hot[1])
    return similar.drop_redundant(everything, keys=("label",)).select("chunk_id", "label")


@query("nearest_other", "WITH " + COS_SQL + """,
g AS (SELECT query_id, chunk_id, embedding FROM ranked JOIN embeddings ON vec_id = chunk_id WHERE rank <= 100 AND cos >= 0),
p AS (SELECT a.query_id, a.chunk_id, b.chunk_id AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM g a JOIN g b ON a.query_id = b.query_id AND a.chunk_id <> b.chunk_id)
SELECT query_id, chunk_id, arg_min(other, d) AS other_id, round(min(d), 6) AS nearest FROM p GROUP BY query_id, chunk_id""")
def nearest_other(spark, sf):
    # among the hits of one question, whose number top-k bounds
    stored = corpus(spark, sf)
    hits = S.search(stored, questions(spark, sf), 100).select("query_id", "chunk_id")
    found = batching.group_distances(S.hits_with(checkpointed(hits), stored, "chunk_id"), ["query_id"], "chunk_id")
    return rounded(found.select("query_id", "chunk_id", "other_id", "nearest"), "nearest")


@query("mmr")
def mmr(spark, sf):
    return rounded(retrieval.diverse(corpus(spark, sf), questions(spark, sf), k=10, fetch_k=50), "distance")


@query("svm_retrieve")
def svm_retrieve(spark, sf):
    return rounded(retrieval.svm_hits(corpus(spark, sf), questions(spark, sf), 50, threshold=0.1), "score")


@query("svm_settled", """
SELECT label AS query_id, true AS settled, true AS few_passes, count(*) AS n_own FROM embeddings GROUP BY label""")
def svm_settled(spark, sf):
    """Whether the fitted directions lie where the loss has no slope, summed anew over the corpus by columns."""
    asked = checkpointed(questions(spark, sf).select("query_id", V.l2_normalise(F.col("embedding")).alias("embedding")))
    stored = checkpointed(corpus(spark, sf).select("chunk_id", "label", V.l2_normalise(F.col("embedding")).alias("embedding")))
    n, cost = stored.count(), 0.1
    weights, passes, _ = retrieval.exemplar_weights(stored, asked, n)
    fitted = spark.createDataFrame([(q, [float(v) for v in w]) for q, w in weights.items()], "query_id int, w array<double>")
    with_one = F.concat(F.col("embedding"), F.array(F.lit(1.0)))
    # one row per question: bounded by the directions that were collected
    pairs = stored.select(with_one.alias("x"), F.lit(1.0).alias("sign"), F.lit(cost * (n + 1) / (2.0 * n)).alias("c")).join(
        F.broadcast(fitted), F.col("c").isNotNull()).unionByName(asked.join(fitted, "query_id").select(
            with_one.alias("x"), F.lit(-1.0).alias("sign"), F.lit(cost * (n + 1) / 2.0).alias("c"), "query_id", "w"))
    lack = F.greatest(1.0 + F.col("sign") * V.dot(F.col("x"), F.col("w")), F.lit(0.0))
    pushed = let(2.0 * F.col("c") * F.col("sign") * lack, lambda share: F.transform("x", lambda v: share * v))
    parts = pairs.select("query_id", F.posexplode(pushed).alias("at", "part"))
    sums = parts.groupBy("query_id", "at").agg(F.sum("part").alias("part")).join(
        fitted.select("query_id", F.posexplode("w").alias("at", "own")), ["query_id", "at"])
    slope = sums.groupBy("query_id").agg(F.max(F.abs(F.col("part") + F.col("own"))).alias("slope"))
    sizes = stored.groupBy(F.col("label").alias("query_id")).agg(F.count("*").alias("n_own"))
    return slope.join(sizes, "query_id").select(
        F.col("query_id").cast(asked.schema["query_id"].dataType).alias("query_id"), (F.col("slope") < 1e-6).alias("settled"),
        F.lit(passes <= 100).alias("few_passes"), "n_own")


@query("hit_lookup", "WITH " + COS_SQL + """
SELECT query_id, rank, chunk_id, label FROM ranked JOIN embeddings ON vec_id = chunk_id WHERE rank <= 100 AND cos >= 0""")
def hit_lookup(spark, sf):
    stored = corpus(spark, sf)
    hits = S.search(stored, questions(spark, sf), 100)
    found = S.hits_with(checkpointed(hits), stored.select("chunk_id", "label"), "chunk_id")
    return found.select("query_id", "rank", "chunk_id", "label")


@query("index_roundtrip", """
SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) /
    sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS total FROM embeddings""")
def index_roundtrip(spark, sf):
    from corpusmill.operators.scratch import scratch_folder

    folder = scratch_folder(spark, "store")
    store.save(store.build(table(spark, sf, "embeddings"), "compressed"), folder, backend="compressed")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return store.load(spark, folder).select("vec_id", "label", F.round(total, 6).alias("total"))


@query("index_union", """
SELECT chunk_id, label FROM (SELECT vec_id AS chunk_id, label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings)""")
def index_union(spark, sf):
    one = corpus(spark, sf)
    other = one.withColumn("chunk_id", F.col("chunk_id") + 1_000_000)
    return store.merge(one, other).select("chunk_id", "label")


@query("index_append", """
SELECT label, count(*) AS n, min(chunk_id) AS lowest, max(chunk_id) AS highest FROM (
  SELECT vec_id AS chunk_id, label FROM embeddings UNION ALL SELECT -1 - vec_id, label FROM embeddings) GROUP BY label""")
def index_append(spark, sf):
    one = corpus(spark, sf)
    grown = store.append(one, one.withColumn("chunk_id", -1 - F.col("chunk_id")))
    return grown.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("lowest"),
                                      F.max("chunk_id").alias("highest"))


@query("delete_ids", "SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_ids(spark, sf):
    bad = table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("chunk_id"))
    return store.delete(corpus(spark, sf), bad).select("chunk_id", "label")


@query("pca_reduce")
def pca_reduce(spark, sf):
    from corpusmill.operators.reduction import reduce_dimensions

    reduced = reduce_dimensions(table(spark, sf, "embeddings"), 48)
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return reduced.select("vec_id", F.size("embedding").alias("width"), F.round(size, 6).alias("energy"))
