"""Percentiles, regime, positioning z-scores, option exposure and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.functions.options import bs_gamma, exposure
from tidemark.functions.ts import clip, sma
from tidemark.sources.readers import last_rows


def percentile_of_last(series: DataFrame, *, by: str = "series_id", keep: int = 252, least: int = 20) -> DataFrame:
    """Share of the last ``keep`` values that are at most the last one; .5 with under ``least``."""
    cut = last_rows(series, [by], "d", keep)
    last = F.first("value").over(Window.partitionBy(by).orderBy(F.desc("d")))
    g = cut.withColumn("le", (F.col("value") <= last).cast("double")).groupBy(by).agg(F.avg("le").alias("p"), F.count(F.lit(1)).alias("n"), F.max_by("value", "d").alias("last"))
    return g.select(by, F.when(F.col("n") < least, 0.5).otherwise(F.col("p")).alias("percentile"), "n", "last")


def regime(bars: DataFrame, benchmark, series: DataFrame, *, vix: str, credit: str) -> DataFrame:
    """One row: risk score and label from the benchmark's trend and two stress percentiles."""
    spy = ts.prepared(bars.where(F.col("asset") == benchmark)).select("n", (F.try_divide("close", sma("close", 200)) - 1).alias("t"), ts.is_last().alias("_last")).where("_last")
    trend = spy.agg(F.coalesce(F.max(F.when(F.col("n") > 200, clip(F.col("t") * 8))), F.lit(0.0)).alias("spy_trend"))
    p = percentile_of_last(series).agg(F.coalesce(F.max(F.when(F.col("series_id") == vix, F.col("percentile"))), F.lit(0.5)).alias("vix_percentile"), F.coalesce(F.max(F.when(F.col("series_id") == credit, F.col("percentile"))), F.lit(0.5)).alias("hy_percentile"))
    stress = (F.col("vix_percentile") + F.col("hy_percentile")) / 2
    risk = clip(0.6 * F.col("spy_trend") - 0.8 * (stress - 0.5) * 2)
    one = trend.crossJoin(F.broadcast(p)).withColumn("risk_score", risk)
    return one.withColumn("label", F.when(F.col("risk_score") > 0.2, "risk-on").when(F.col("risk_score") < -0.2, "risk-off").otherwise("neutral / transition"))


# Field, family, and whether a crowd there is faded.
POSITIONS = (("lev_money_net", "cot_leveraged_positioning", True), ("mgd_money_net", "cot_managed_money_positioning", True), ("asset_mgr_net", "cot_asset_manager_positioning", False), ("dealer_net", "cot_dealer_positioning", False))


def positioning_signals(rows: DataFrame, *, keep: int = 104, least: int = 8) -> DataFrame:
    """market, family, z, percentile, signal from each field's last ``keep`` weeks."""
    long = rows.unpivot(["market", "d"], [f for f, _, _ in POSITIONS], "field", "value")
    cut = last_rows(long, ["market", "field"], "d", keep)
    last = F.first("value").over(Window.partitionBy("market", "field").orderBy(F.desc("d")))
    g = cut.withColumn("le", (F.col("value") <= last).cast("double")).groupBy("market", "field").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.avg("le").alias("p"), F.count(F.lit(1)).alias("n"), F.max_by("value", "d").alias("last"))
    z = F.when(F.col("n") < least, 0.0).otherwise((F.col("last") - F.col("m")) / (F.col("sd") + 1e-9))
    names = F.create_map(*[F.lit(x) for f, fam, _ in POSITIONS for x in (f, fam)])
    sign = F.when(F.col("field").isin(*[f for f, _, c in POSITIONS if c]), -1.0).otherwise(1.0)
    return g.select("market", names[F.col("field")].alias("family"), z.alias("z"), F.when(F.col("n") < least, 0.5).otherwise(F.col("p")).alias("percentile"), clip(sign * z / 2).alias("signal"))


def net_gamma(chain: DataFrame, *, expiries: int = 4) -> DataFrame:
    """ticker, net_gex_bn, regime, spot over each ticker's first expiries: ticker, expiry, right, strike, iv, oi, spot, years."""
    near = F.dense_rank().over(Window.partitionBy("ticker").orderBy("expiry"))
    rows = chain.withColumn("_k", near).where((F.col("_k") <= expiries) & (F.col("years") > 0))
    g = rows.withColumn("g", bs_gamma(F.col("spot"), F.col("strike"), F.col("years"), F.coalesce("iv", F.lit(0.0))))
    net = g.groupBy("ticker").agg(F.sum(exposure(F.col("right"), F.col("spot"), F.col("g"), F.col("oi"))).alias("net"), F.max("spot").alias("spot")).where("net is not null and not isnan(net)")
    return net.select("ticker", (F.col("net") / 1e9).alias("net_gex_bn"), F.when(F.col("net") >= 0, "positive (vol-dampening)").otherwise("negative (vol-amplifying)").alias("regime"), "spot")


def curve_snapshot(series: DataFrame) -> DataFrame:
    return series.where("value is not null").groupBy("series_id").agg(F.max_by("value", "d").alias("value"), F.max("d").alias("d"))


def implied_bps(one_year: float | None, effective: float | None) -> float | None:
    return None if one_year is None or effective is None else round((one_year - effective) * 100, 1)


def scenarios(state: DataFrame) -> DataFrame:
    """id and whether it is active, from one row: label, vix_percentile, rate_percentile, days_to_event, crowded."""
    ids = ("vol_spike", "rate_shock", "crowding_unwind", "theme_reversal", "liquidity_event")
    rows = state.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    active = (
        F.when(F.col("id") == "vol_spike", (F.col("label") == "risk-off") | (F.col("vix_percentile") > 0.85))
        .when(F.col("id") == "rate_shock", F.col("rate_percentile") > 0.85)
        .when(F.col("id") == "liquidity_event", F.col("days_to_event") <= 5)
        .when(F.col("id") == "crowding_unwind", F.col("crowded").isNotNull())
    )
    return rows.crossJoin(F.broadcast(state)).select("id", F.coalesce(active, F.lit(False)).alias("active"))


def crowded(over: DataFrame) -> DataFrame:
    """The first asset by conviction that two families sell and flows know."""
    return over.where((F.col("sell_count") >= 2) & F.array_contains("segments", "flows")).orderBy(F.desc("conviction"), "asset").limit(1).select("asset")
