"""What executors need from the driver: a shared folder, and this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only where it is unset (tests) a temporary folder stands in."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        have = "file://" + tempfile.mkdtemp(prefix="wayframe-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give this package's code to the Python workers, unless their path has it."""
    app = spark.sparkContext.applicationId
    if app in _shipped or _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="wayframe-code-"), "wayframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "wayframe")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
