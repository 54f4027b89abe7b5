"""Gives the executors the code of this repository, which they need for Python functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="code-")) / "tessera_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in [*sorted((root / "tessera").rglob("*.py")), *sorted(root.glob("corpus_pipeline.py"))]:
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
