"""Sends this package to the Python workers, for sessions whose workers can't import it by themselves."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: Spark serves a zip of the package to every executor, also to ones that start later."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        _SENT.add(app)
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        copy = tempfile.mkdtemp(prefix="jobscope-")
        shutil.copytree(f"{top}/jobscope", f"{copy}/src/jobscope", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{copy}/jobscope", "zip", f"{copy}/src"))
