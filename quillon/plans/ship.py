"""Make this package importable on the executors, wherever the session was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    folder = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "quillon_source.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for inner, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(inner, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
