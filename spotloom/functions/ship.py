"""Make this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to all executors as a zip file (``addPyFile``), once per application."""
    app = spark.sparkContext.applicationId
    if app not in _done:
        root = Path(__file__).resolve().parents[2]
        if root.is_dir():  # already running from a shipped archive otherwise
            archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spotloom-')}/spotloom-package", "zip", root, "spotloom")
            spark.sparkContext.addPyFile(archive)
        _done.add(app)
