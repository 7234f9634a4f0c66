"""Adapters that read transaction tables as the engine's data model.

bars: asset, d, open, high, low, close, volume. tags: asset, label, region, grp.
ticks: key, ts, value. macro: series_id, d, value. Sources stay lazy, so column
pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str, asset: str = "l_suppkey") -> DataFrame:
    """Bars by asset and day from line items; one exchange on (asset, day), partial sums before it."""
    li = read(spark, sf_dir, "lineitem").where("l_quantity > 0")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = li.select(F.col(asset).cast("long").alias("asset"), F.col("l_shipdate").cast("date").alias("d"), price.alias("p"), "l_quantity", order.alias("o"))
    return rows.groupBy("asset", "d").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("l_quantity").alias("volume"))


def supplier_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's nation as label, region, and one of two groups by balance."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    dim = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey"), F.col("n_name").alias("label"), F.col("r_name").alias("region"))
    return s.join(F.broadcast(dim), s.s_nationkey == dim.n_nationkey).select(F.col("s_suppkey").cast("long").alias("asset"), "label", "region", F.when(F.col("s_acctbal") >= 0, "style").otherwise("industry").alias("grp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean of each event type."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("d")).agg(F.avg("value").alias("value"))


def factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly change of each market segment's order value: factor, region, m, r."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("factor"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    from pyspark.sql import Window

    prev = F.lag("v").over(Window.partitionBy("factor").orderBy("m"))
    return rows.withColumn("r", F.try_divide("v", prev) - 1).where("r is not null").select("factor", F.substring("factor", 1, 1).alias("region"), "m", "r")


def positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly net order value by market segment: open orders long, filled ones short."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    week = F.date_trunc("week", F.col("o_orderdate").cast("date")).cast("date")
    net = F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(0.0))
    gross = F.sum("o_totalprice")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("market"), week.alias("d")).agg(net.alias("lev_money_net"), (gross - net).alias("asset_mgr_net"), F.count(F.lit(1)).cast("double").alias("dealer_net"), F.max("o_totalprice").alias("mgd_money_net"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items of pages: seq, link, title, summary, source."""
    p = read(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("seq"), F.col("url").alias("link"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("summary"), F.regexp_extract("url", "//([^/]+)", 1).alias("source"))
