"""Give the executors this package, so that functions sent to them find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session as a zip, once per application.

    Spark serves the file from the driver to every executor, also to those that join
    later.  A job submitted with --py-files does not need it, and loses nothing by it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="airloom-"), "airloom_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"airloom/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
