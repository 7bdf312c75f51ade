"""Executors get the package with the job, so that Python workers anywhere can import it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors of this application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    top = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    path = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
