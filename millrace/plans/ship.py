"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once: its functions run in workers that may
    not find it on a path of their own."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="millrace-"))
    path = os.path.join(folder, f"millrace-{os.path.basename(folder)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    context.addPyFile(path)
    context._millrace_shipped = True
