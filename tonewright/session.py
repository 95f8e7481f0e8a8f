"""Makes the package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="tonewright-")).resolve() / "tonewright.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
        # Workers that Spark starts on the driver itself (for stateful streams) don't get added files.
        known = context.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(path), known]))
        _shipped.add(context.applicationId)
    return spark
