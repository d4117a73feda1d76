"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (
    alignment,
    ann,
    covertree,
    jaccard,
    language,
    lexical,
    licenses,
    mixing,
    packing,
    rules,
    sharding,
    token_files,
    toxicity,
)
from corpusmill.llm.sampling import fold_of
from corpusmill.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its check if SQL can say it."""

    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# rows reached over links (a, b), and the smallest of them
REACH_SQL = """
reach AS (SELECT {id} AS id, {id} AS other FROM {table} UNION
  SELECT r.id, e.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) e ON r.other = e.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

JACCARD_SQL = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),""" + REACH_SQL.format(
    id="doc_id", table="documents") + """
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN least ON id = doc_id"""

NEAR_SQL = """WITH RECURSIVE
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.93),""" + REACH_SQL.format(id="vec_id", table="embeddings") + """,
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.id = vec_id LEFT JOIN counts ON counts.id = vec_id"""

RANK_SQL = r"""WITH
d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT r, doc_id, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT r, doc_id, 50 + (50 * n * docs) // terms AS m FROM n, c),
f AS (SELECT r, term, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, q.text, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 50"""

# targets: the words a unit of weight gets rises until no further source is full
TARGETS_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS full_at, coalesce(sum(3 * source_size) OVER a, 0) AS full_before,
  sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s
  WINDOW a AS (ORDER BY 3.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(((SELECT sum(source_size) FROM s) - full_before)::DOUBLE / open_w, (full_at, source)) AS level FROM r
  WHERE full_at >= ((SELECT sum(source_size) FROM s) - full_before)::DOUBLE / open_w)
SELECT doc_id, size, source_size, round(least(3 * source_size, level * w), 6) AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, l"""

DIGEST_SQL = """WITH n AS (SELECT count(*) AS n FROM documents), i AS (SELECT unnest(range(40)) AS i)
SELECT 'rows' AS law, (n // 40 + CASE WHEN i < n % 40 THEN 1 ELSE 0 END)::BIGINT AS rows_of_shard, count(*) AS shards,
  (SELECT sum(octet_length(encode(coalesce(text, ''))) + 16) FROM documents)::BIGINT AS bytes_of_all FROM n, i GROUP BY ALL"""


@query("op1_ann")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op2_licenses")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license passage of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts, equal texts together."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, one row per piece."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back from them."""
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), end_id=2)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_jaccard", JACCARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard of 0.75 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the weights 5, 2, 1 of their sources."""
    return mixing.mix(table(spark, sf_dir, "documents"), cycle=(5, 2, 1)).select(
        "doc_id", *(F.col(f"mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold_of("doc_id", 3) != 1))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"))


@query("op9_near_vectors", NEAR_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of a label whose cosine is 0.93 or more."""
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), 5, 0))
    return toxicity.score(docs.select("doc_id", "text"), grammar).select(
        "doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of two tokenizers end together, in every document."""
    return alignment.align_counts(table(spark, sf_dir, "documents"))


@query("op12_lexical", RANK_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for the words of every benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query("op13_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    model = rules.train(docs, table(spark, sf_dir, "labels"), "quality", 5, 0)
    return rules.score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


@query("mixing_targets", TARGETS_SQL)
def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can say: sizes and targets."""
    return op7(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


@query("sharding_digest", DIGEST_SQL)
def sharding_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the sharding that SQL can say: how many shards have how many rows, and the bytes of all."""
    shards = op3(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("rows_of_shard"), F.sum("size").alias("bytes"), F.min("law").alias("law"))
    total = shards.agg(F.sum("bytes").alias("bytes_of_all"))
    return shards.groupBy("law", "rows_of_shard").agg(F.count("*").alias("shards")).join(F.broadcast(total))


def load():
    return QUERIES, ORACLES
