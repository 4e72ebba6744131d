"""The package's way to the workers of a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to all workers of the session, once: Spark serves the archive from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped or context.master.split("[")[0] == "local":
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="quern-")  # the driver's own: it serves the file from there until it ends
    atexit.register(shutil.rmtree, folder, True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "quern"), "zip", root, "quern"))
    _shipped.add(context.applicationId)
