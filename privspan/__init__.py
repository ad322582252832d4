"""Gaussian privacy spectra and the relational work around them, as Spark jobs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a session's context."""
    context = spark.sparkContext
    if not getattr(context, "_privspan_shipped", False):
        root = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="privspan-")) / "privspan.zip"
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(path))
        context._privspan_shipped = True
    return spark
