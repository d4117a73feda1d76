"""Making the package importable where tasks run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors, once per application.

    Spark serves the archive itself; where the package is installed on every
    node, or given with ``--py-files``, this is only a second copy.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpusmill-py-")) / "corpusmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
