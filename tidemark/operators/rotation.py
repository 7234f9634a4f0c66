"""Relative strength and factor rotation: benchmark-relative and peer-group signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.functions.ts import change, clip, sma
from tidemark.functions.xs import peer_score
from tidemark.operators.models import _time_series_momentum

FRAMES = {"1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252}


def relative_strength(bars: DataFrame, benchmark) -> DataFrame:
    """Families of themes at each asset's last bar against one benchmark asset, by position from the end.

    The benchmark is one row, so it is broadcast.
    """
    cols = [F.try_divide("close", f"lag_{k - 1}").alias(f"g{k}") for k in (21, 63, 126)]
    last = ts.featured_last(bars).select("asset", "d", "n", *cols, (F.try_divide("close", "sma_200") - 1).alias("t200"))
    b = last.where(F.col("asset") == benchmark).select(*[F.col(c).alias(f"b_{c}") for c in ("n", "g21", "g63", "g126")]).limit(1)
    j = last.crossJoin(F.broadcast(b))
    rs = {k: F.when((F.col("n") >= k + 2) & (F.col("b_n") >= k + 2), F.tanh(5 * (F.try_divide(f"g{k}", f"b_g{k}") - 1))).otherwise(0.0) for k in (21, 63, 126)}
    return j.select("asset", "d", clip(0.6 * rs[63] + 0.4 * rs[126]).alias("relative_strength"), clip(rs[21]).alias("rs_short"), clip(rs[126]).alias("rs_long"), clip(F.col("t200") * 6).alias("trend_vs_200dma"))


def factor_rotation(bars: DataFrame, tags: DataFrame) -> DataFrame:
    """frm_ts_mom, frm_cs_region, frm_cs_peer and frm_composite of each tagged asset."""
    r12 = F.when(F.col("n") >= 254, F.try_divide("lag_21", "lag_252") - 1)
    last = ts.featured_last(bars).select("asset", "d", clip(_time_series_momentum()).alias("ts"), r12.alias("r12"))
    j = last.join(tags, "asset")
    x = j.withColumn("cs", peer_score("r12", ["grp", "region"])).withColumn("peer", peer_score("r12", ["grp", "label"]))
    return x.select("asset", "d", "grp", "region", "label", F.col("ts").alias("frm_ts_mom"), F.col("cs").alias("frm_cs_region"), F.col("peer").alias("frm_cs_peer"), clip(0.6 * F.col("ts") + 0.3 * F.col("cs") + 0.1 * F.col("peer")).alias("frm_composite"))


def rotation_by_timeframe(bars: DataFrame, tags: DataFrame, frames: dict[str, int] = FRAMES) -> DataFrame:
    """Peer scores of plain trailing returns for each look-back; assets without the history are left out."""
    rows = ts.tail(bars, max(frames.values()) + 1)
    cols = [F.when(F.col("n") >= k + 2, change("close", k)).alias(f) for f, k in frames.items()]
    last = rows.select("asset", "n", "rk", *cols).where("rk = 1 and n >= 60")
    long = last.unpivot(["asset"], list(frames), "timeframe", "r").where("r is not null").join(tags, "asset")
    return long.select("timeframe", "asset", "label", "grp", "region", peer_score("r", ["timeframe", "grp", "region"]).alias("signal"))


def alpha_combo(bars: DataFrame) -> DataFrame:
    """Blend of three ranked alphas on the last day of the panel; 0 for an asset without that day.

    Returns are not filled over gaps. Legs without a value count as 0 next to
    another one. One exchange by asset for the windows, one by day for all ranks.
    """
    from tidemark.functions.xs import pct_rank

    rows = ts.tail(bars, 40)
    legs = rows.select("asset", "d", (-change("close", 5)).alias("a"), change("close", 20).alias("b"), F.try_divide("volume", sma("volume", 20)).alias("v"), (-ts.correlation("close", "volume", 10)).alias("c"))
    day = legs.agg(F.max("d").alias("d"))
    today = legs.join(F.broadcast(day), "d", "left_semi")
    r = today.select("asset", (pct_rank("a", ["d"]) * 2 - 1).alias("a"), ((pct_rank("b", ["d"]) * 2 - 1) * F.when(F.col("v").isNotNull(), F.greatest(pct_rank("v", ["d"]), F.lit(0.2)))).alias("b"), (pct_rank("c", ["d"]) * 2 - 1).alias("c"))
    some = F.coalesce("a", "b", "c").isNotNull()
    blend = F.when(some, (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)) + F.coalesce("c", F.lit(0.0))) / 3)
    assets = bars.select("asset").distinct()
    return assets.join(r.select("asset", blend.alias("x")), "asset", "left").select("asset", clip(F.col("x")).alias("formulaic_alpha_combo"))
