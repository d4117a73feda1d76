"""Cutting the lineage of iterative jobs in storage every executor can read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return the stored copy.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session, where driver and executors share a disk, may fall back on a
    temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="corpusmill-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
