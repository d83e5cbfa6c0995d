"""Makes the package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once for each application; Spark's own file server carries them."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(SparkFiles.getRootDirectory(), "candlewright-src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _DONE.add(sc.applicationId)
