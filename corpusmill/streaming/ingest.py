"""Adding new files to a store as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import content_hash, est_tokens, strip


def ingest_folder(spark: SparkSession, folder: str, store: str, checkpoint: str) -> None:
    """Append the texts that appeared since the last run, each content once.

    The stream remembers which files it has read; content already stored is
    dropped by an anti-join on its hash. ``store`` and ``checkpoint`` belong in
    storage all executors share. Runs until nothing is left, then stops.
    """
    files = (spark.readStream.format("text").option("wholetext", "true").load(folder)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("page_content")))
    docs = files.filter(strip(F.col("page_content")) != "").withColumns({
        "content_hash": content_hash(F.col("page_content")), "tkn_length": est_tokens(F.col("page_content"))})

    def append(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        fresh = batch.groupBy("content_hash").agg(F.min_by(F.struct("path", "page_content", "tkn_length"), "path").alias("d"))
        fresh = fresh.select("content_hash", "d.*")
        if _exists(session, store):
            fresh = fresh.join(session.read.parquet(store).select("content_hash"), "content_hash", "left_anti")
        fresh.write.mode("append").parquet(store)

    query = (docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _exists(spark: SparkSession, folder: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(folder).columns)
    except AnalysisException:
        return False
