"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, as a
stored table. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import jaccard, language, mixing, packing, toxicity
from corpusmill.llm.stores import fresh, stored
from corpusmill.registry import table

TOXIC = 0.5        # documents of this score or more go
UNSURE = 0.4       # documents whose language is less sure go
SMALL_SIDE = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC; the grammar learns from table ``labels`` (see ``labelled_rows``).

    Null and empty texts are scored like any other, and stay.
    """
    labels = table(spark, sf_dir, "labels")
    grammar = toxicity.train(toxicity.training_rows(docs, labels))
    score, = fresh(docs, "_toxicity")
    scored = toxicity.score(docs.withColumnRenamed("toxicity", score) if "toxicity" in docs.columns else docs, grammar)
    return scored.where(F.col("toxicity") < TOXIC).select(
        *(F.col(score).alias("toxicity") if c == "toxicity" else F.col(c) for c in docs.columns))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language; the model learns from their column ``lang``.

    Null texts, texts without letters and such whose best language is less sure than
    UNSURE go. If no document has a language to learn from, all stay.
    """
    model = language.train(docs)
    if not model.languages:
        return docs
    found = language.predict(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= UNSURE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard 0.75 or more connect: the first as stored.

    Rows are told apart by numbers, stored with them, so equal and null ids are
    no matter. Texts without words link with nothing and stay.
    """
    row, = fresh(docs, "_row")
    # stored, as the numbers follow the splits of the files, which may change from job to job
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard.jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text"))
    copies = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(row)), "copies")
    # a number a row, some 50 bytes in a hash table: 25 MB at the bound; above it the join is dealt by row
    gone = F.broadcast(copies) if copies.count() <= SMALL_SIDE else copies
    return numbered.join(gone, row, "left_anti").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none more than three times.

    A document of which the mix takes a part is rounded to a whole repetition, so no text is
    cut: at most one per source. Documents that the mix does not take go, among them those
    without words. The mix works on three numbers a document; texts are not moved.
    """
    safe = docs.select(*(F.col(c).alias(f"c_{c}") for c in docs.columns), "doc_id", "text", "source")
    taken = mixing.mix(safe)
    repeats = F.col("mix_repeats") + F.when((F.col("mix_rest") > 0) & (2 * F.col("mix_rest") >= F.col("mix_size")), 1).otherwise(0)
    copies = taken.withColumn("mix_copies", repeats).where("mix_copies > 0").withColumn(
        "mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return copies.select(*(F.col(f"c_{c}").alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of 2048, one row per piece. A null or empty text is its end id alone."""
    return packing.pack(docs, window=2048, end_id=1)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_copies", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None  # no stage but the fourth can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
