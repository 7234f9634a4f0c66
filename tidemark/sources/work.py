"""The folder that driver and executors share, for what a run keeps beside its results."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder serves a session of one process.

    On a cluster an unset folder is an error: no local one would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def age_hours(spark: SparkSession, path: str) -> float | None:
    """Hours since the path was written; None where there is none."""
    if not exists(spark, path):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    written = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()
    return (spark._jvm.java.lang.System.currentTimeMillis() - written) / 3_600_000.0
