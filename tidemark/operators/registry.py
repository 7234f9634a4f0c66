"""Model weights and research notes as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weight_of(weights: DataFrame, family: str, default: float = 1.0) -> float:
    row = weights.where(F.col("family") == family).select("w").first()
    return default if row is None else float(row["w"])


def set_weight(weights: DataFrame, family: str, w: float) -> DataFrame:
    return weights.where(F.col("family") != family).unionByName(weights.sparkSession.createDataFrame([(family, float(w))], "family string, w double"))


NOTE = "ts timestamp, family string, title string, abstract string, source string, status string"


def add_note(notes: DataFrame, note: tuple, title: int = 200, abstract: int = 4000) -> DataFrame:
    """Newest first; long titles and abstracts are cut."""
    new = notes.sparkSession.createDataFrame([note], NOTE)
    return notes.unionByName(new.withColumn("title", F.left("title", F.lit(title))).withColumn("abstract", F.left("abstract", F.lit(abstract)))).orderBy(F.desc("ts"))
