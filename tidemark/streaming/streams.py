"""Streaming forms of the incremental run: deduplication and bars from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import load
from tidemark.sources.work import exists


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """First event of each key; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_unseen(batch: DataFrame, batch_id: int, out_path: str, key: str = "id") -> None:
    """For ``foreachBatch`` where ids never expire: the seen ids are those of the output's other batches.

    A batch is one write to a partition of its own, so that one which is run again
    after a crash replaces what it had written and adds nothing twice.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    if exists(spark, out_path):
        fresh = fresh.join(spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, batch long").parquet(out_path).where(F.col("batch") != batch_id).select(key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")


def drained(stream: DataFrame, path: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is now and return its table, held as files in the shared folder.

    Each batch is a partition. With ``keys`` batches hold updates, and a key's last one
    counts.
    """
    spark = stream.sparkSession
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/batch={i}")
    done = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode("update" if keys else "append").trigger(availableNow=True).start()
    done.awaitTermination()
    rows = load(spark, path, "out", stream.schema.add("batch", "long"))
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, "_x.*")


def bars(ticks: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Open, high, low, close and count of ticks by key and window; batch or stream alike."""
    rows = ticks.withWatermark("ts", late) if late else ticks
    g = rows.groupBy("key", F.window("ts", width)).agg(F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("n"))
    return g.select("key", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")
