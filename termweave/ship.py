"""Makes the package importable in Python workers that do not share the driver's sys.path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the workers once per application, by Spark's own file server."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="termweave-"), "termweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
