"""Make this package importable by Python workers wherever they run."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path that all executors reach, under ``spark.checkpoint.dir``; it goes when the application ends.

    Without that setting a local master has a temporary folder, and a cluster gets an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{label}-{uuid.uuid4().hex}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return at.toString()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once for each application.

    Spark serves the archive itself, so driver and executors need no common folder.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    folder = tempfile.mkdtemp(prefix="spark-")
    path = os.path.join(folder, f"{top.name}.zip")
    Path(path).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
