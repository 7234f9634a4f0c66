"""Sinks: named artefacts, day archives that merge by id, append-only signal history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.work import age_hours, exists


def save(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str, schema: T.StructType | str) -> DataFrame:
    """The artefact, or no rows of ``schema`` where there is none. One that can't be read is an error."""
    path = f"{root}/{name}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def cached(spark: SparkSession, root: str, name: str, max_age_hours: float = 18.0) -> DataFrame | None:
    """The artefact if it was written at most ``max_age_hours`` ago."""
    age = age_hours(spark, f"{root}/{name}")
    return spark.read.parquet(f"{root}/{name}") if age is not None and age <= max_age_hours else None


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; of equal keys the new one."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n")))
    return both.withColumn("_k", last).where("_k = 1").drop("_k", "_n")


def archive_day(df: DataFrame, root: str, name: str, day: str, key: str = "id") -> None:
    """One partition a day. A rerun merges with what the day holds: of equal keys the new row stays.

    The merged day is written beside the archive first, since it is read from it.
    """
    spark, path = df.sparkSession, f"{root}/{name}"
    out = df
    if exists(spark, f"{path}/day={day}"):
        out = merged(spark.read.schema(df.schema).parquet(f"{path}/day={day}"), df, key)
        out.write.mode("overwrite").parquet(f"{root}/_{name}_day")
        out = spark.read.parquet(f"{root}/_{name}_day")
    out.withColumn("day", F.lit(day).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def archive_dates(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The archive's days, newest first; none where there is no archive."""
    days = load(spark, root, name, "day date").select("day")
    return days.distinct().orderBy(F.desc("day"))


def usage(status: DataFrame) -> DataFrame:
    """calls and usd by way of fetching, over the status rows of a run."""
    return status.where("via is not null").groupBy("via").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))


def as_document(df: DataFrame) -> DataFrame:
    """Rows as JSON strings."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
