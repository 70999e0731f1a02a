"""Sends this package to the executors, whose Python need not find it by itself."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the executors' Python path, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="riftline-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, f"{root.name}/{file.relative_to(root)}")
        context.addPyFile(path)
        _sent.add(context.applicationId)
    return spark
