"""Let executors import this package, wherever the driver has it from."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_pagemill_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="pagemill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/pagemill.zip", "w") as z:
        for at, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(top)))
    context.addPyFile(f"{folder}/pagemill.zip")
    context._pagemill_shipped = True
