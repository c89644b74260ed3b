"""Sending this package to the executors, whose Python workers must be able to import it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(str(p.relative_to(root.parent)), p.read_bytes())
    # addPyFile takes a file of the driver and serves it to the executors
    folder = Path(tempfile.mkdtemp(prefix="gaugeline-ship-"))
    (folder / "gaugeline_pkg.zip").write_bytes(blob.getvalue())
    spark.sparkContext.addPyFile(str(folder / "gaugeline_pkg.zip"))
    _SHIPPED.add(app)
