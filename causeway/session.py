"""Making the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, unless PYTHONPATH already names its folder."""
    context = spark.sparkContext
    if context.applicationId in _sent or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _sent.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="causeway-")) / "causeway.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
