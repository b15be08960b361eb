"""Make the package known to Python workers that would not find it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once an application, unless their path has it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    on_path = [os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in on_path or os.path.abspath(".") == root:
        return
    work = tempfile.mkdtemp(prefix="rankloom-src-")
    shutil.copytree(os.path.join(root, "rankloom"), os.path.join(work, "src", "rankloom"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(work, "rankloom"), "zip", os.path.join(work, "src")))
    shutil.rmtree(os.path.join(work, "src"))
    _shipped.add(app)
