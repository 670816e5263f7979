"""Ships this package to the Python workers of a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``'s executors, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/tidemark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
    sc._tidemark_shipped = True
