"""Shared plumbing: tables in the cluster's shared folder and size-checked collection."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.work import shared_dir

_written: list[tuple[SparkSession, str]] = []
#: Intermediate tables are read once or twice but take room beside the shuffles.
_WRITTEN = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_here(spark: SparkSession):
    """Spark deletes the shuffle files of what is written inside as soon as it is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and read it again.

    Cuts the lineage and survives lost executors. The table is removed when the
    driver ends.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = _path(spark, name)
    with shuffles_end_here(spark):
        df.write.options(**_WRITTEN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """``stored``, bucketed by ``key``: what groups by it reads the table in place."""
    spark = df.sparkSession
    path = _path(spark, name)
    called = f"tidemark_{path.rsplit('/', 1)[-1].replace('-', '_')}"
    with shuffles_end_here(spark):
        df.repartition(n, key).write.options(**_WRITTEN, path=path).bucketBy(n, key).sortBy(key).saveAsTable(called)
    return spark.table(called)


def _unlink(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _unlink(spark, path)
        except Exception:  # the session may be gone already; the folder is temporary
            return


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collect a table whose size is bounded; a larger one raises instead of being cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; raise the bound")
    return rows


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; counting stops there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_batches(spark: SparkSession, bytes_: int = 8 << 20) -> None:
    """Arrow batches of at most ``bytes_`` in this session, however long the texts are; a smaller bound stays.

    The setting stays too, since plans run after they are made.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if now <= 0 or now > bytes_:
        spark.conf.set(key, str(bytes_))


def parts_for(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
