"""Consensus, overlap and heat-map over signal records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The families of the two effects.
BEHAVIORAL = ("mean_reversion", "rsi_reversion", "cot_leveraged_positioning", "cot_managed_money_positioning", "etf_volume_flow_proxy")
PHYSICAL = ("momentum", "ma_single_200", "ma_cross_50_200", "multi_ma", "donchian_breakout", "vol_regime", "trend_following", "risk_regime", "relative_strength", "rs_short", "rs_long", "trend_vs_200dma", "cot_dealer_positioning", "cot_asset_manager_positioning", "frm_ts_mom", "frm_cs_region", "frm_cs_peer", "frm_composite")


def mean_to(x, digits: int):
    """Mean of values of four places, rounded half away from zero: by integers, so that it doesn't depend on the order of a sum."""
    total, n = F.sum(F.round(x * 10_000).cast("long")), F.count(x)
    scaled = F.abs(total) * (2 * 10 ** max(0, digits - 4)) + n
    return F.when(n > 0, F.signum(total) * F.floor(scaled / (2 * n)) / 10.0 ** max(4, digits))


def consensus(signals: DataFrame, *, digits: int = 4, weights: DataFrame | None = None) -> DataFrame:
    """One row for each asset.

    Two levels of partial sums: by asset and horizon axis, then by asset; the
    second groups a few rows an asset. ``weights`` (family, w) multiplies signals.
    """
    rows = signals
    if weights is not None:
        rows = rows.join(weights, "family", "left").withColumn("signal", F.col("signal") * F.coalesce("w", F.lit(1.0)))
    axis = F.when(F.col("horizon") == "weeks", 1).when(F.col("horizon") == "months", 2).otherwise(0)
    b, p = F.col("family").isin(*BEHAVIORAL), F.col("family").isin(*PHYSICAL)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sig = F.col("signal")
    by_axis = rows.groupBy("asset", axis.alias("axis")).agg(
        F.sum(sig).alias("s"), F.count(sig).alias("n"), F.sum(F.when(b, sig)).alias("bs"), one(b).alias("bn"), F.sum(F.when(p, sig)).alias("ps"), one(p).alias("pn"),
        one(F.col("state") == "buy").alias("buy"), one(F.col("state") == "neutral").alias("neutral"), one(F.col("state") == "sell").alias("sell"),
        F.collect_set("family").alias("families"), F.min(F.struct("segment", "family", "asset_class"))["asset_class"].alias("cls"), F.min(F.struct("segment", "family")).alias("first"),
    )
    mean = F.try_divide("s", "n")
    sign = F.when(mean > 0.05, 1).when(mean < -0.05, -1).otherwise(0)
    a = by_axis.groupBy("asset").agg(
        *[F.sum(c).alias(c) for c in ("s", "n", "bs", "bn", "ps", "pn", "buy", "neutral", "sell")],
        F.avg(mean).alias("entangle"), F.sum(sign).alias("signs"), F.count(F.lit(1)).alias("axes"), F.size(F.array_distinct(F.flatten(F.collect_list("families")))).cast("long").alias("variety"), F.min_by("cls", "first").alias("asset_class"),
    )
    share = lambda c: F.col(c) / F.col("n")
    entropy = sum((F.when(F.col(c) > 0, -share(c) * F.ln(share(c)) / F.ln(F.lit(3.0))).otherwise(0.0) for c in ("buy", "neutral", "sell")), F.lit(0.0))
    a = a.select(
        "asset", "asset_class", F.try_divide("s", "n").alias("overall"), F.coalesce(F.try_divide("bs", "bn"), F.lit(0.0)).alias("beh"), F.coalesce(F.try_divide("ps", "pn"), F.lit(0.0)).alias("phy"), "entangle",
        F.when(F.col("axes") > 1, F.abs("signs") / F.col("axes")).otherwise(0.5).alias("agree"), "variety", F.round(entropy, 3).alias("entropy"), F.col("n").alias("n_signals"),
    )
    a = a.withColumn("composite", F.round(0.25 * F.col("overall") + 0.25 * F.col("beh") + 0.3 * F.col("phy") + 0.2 * F.col("entangle"), digits))
    conf = F.least(F.lit(1.0), F.col("variety") / 10 * (1 - F.col("entropy")) * (0.5 + F.col("agree") / 2))
    return a.select(
        "asset", "asset_class", "composite", F.when(F.col("composite") >= 0.15, "buy").when(F.col("composite") <= -0.15, "sell").otherwise("neutral").alias("state"),
        F.round("beh", digits).alias("behavioral"), F.round("phy", digits).alias("physical"), F.round("entangle", digits).alias("entanglement"), F.round("agree", digits).alias("horizon_agreement"),
        F.col("variety").alias("signal_variety"), "entropy", F.round(conf, 3).alias("confidence"), "n_signals",
    )


def last_by_family(signals: DataFrame, seq: str) -> DataFrame:
    """One row for each (asset, family): the last in the order of ``seq``."""
    return signals.groupBy("asset", "family").agg(F.max_by("signal", seq).alias("signal"))


def matrix(signals: DataFrame, seq: str) -> DataFrame:
    """asset -> map of family to signal."""
    return last_by_family(signals, seq).groupBy("asset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "signal")))).alias("signals"))


def overlap(signals: DataFrame, seq: str, *, least: float = 0.15, digits: int = 4) -> DataFrame:
    """Assets with counts of aligned families, over the last signal of each family; segments of all rows."""
    last = last_by_family(signals, seq)
    buy, sell = F.col("signal") >= least, F.col("signal") <= -least
    agg = last.groupBy("asset").agg(F.count_if(buy).alias("buy_count"), F.count_if(sell).alias("sell_count"), mean_to(F.col("signal"), digits).alias("net"), F.count(F.lit(1)).alias("families"), F.coalesce(mean_to(F.when(buy | sell, F.abs("signal")), digits), F.lit(0.0)).alias("mean_strength"))
    segs = signals.groupBy("asset").agg(F.array_sort(F.collect_set("segment")).alias("segments"), F.min_by("asset_class", seq).alias("asset_class"))
    out = agg.join(segs, "asset").withColumn("n_segments", F.size("segments").cast("long"))
    return out.withColumn("conviction", F.abs("net") * F.col("n_segments") * F.greatest("buy_count", "sell_count"))


def ranked(over: DataFrame, k: int) -> DataFrame:
    return over.orderBy(F.desc("conviction"), "asset").limit(k)


def heatmap(signals: DataFrame, picks: DataFrame) -> DataFrame:
    """Mean signal by asset and segment of the picked assets."""
    return signals.join(picks.select("asset"), "asset", "left_semi").groupBy("asset", "segment").agg(F.avg("signal").alias("mean_signal"))


def top_and_bottom(df: DataFrame, by: str, k: int, group: list[str] | None = None, tie: str = "asset") -> DataFrame:
    """The k largest and k smallest rows, of each group where given; rank windows that stop at k."""
    keys = group or []
    if not keys:
        return df.orderBy(F.desc(by), tie).limit(k).unionByName(df.orderBy(F.asc(by), tie).limit(k)).distinct()
    up, down = Window.partitionBy(*keys).orderBy(F.desc(by), tie), Window.partitionBy(*keys).orderBy(F.asc(by), tie)
    top = df.withColumn("_k", F.row_number().over(up)).where(F.col("_k") <= k).drop("_k")
    low = df.withColumn("_k", F.row_number().over(down)).where(F.col("_k") <= k).drop("_k")
    return top.unionByName(low).distinct()


def region_pivot(df: DataFrame, regions: list[str], value: str = "signal", how=F.avg) -> DataFrame:
    """label rows, region columns; regions are given, so that no pass is spent to find them."""
    return df.groupBy("label").pivot("region", regions).agg(how(value))
