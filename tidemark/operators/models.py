"""Registry of per-series models and their evaluation in one pass over the bars.

A model is a Column over the trailing windows of an asset, so it has a value on
every row: the last row gives today's signal, any other row its history. All
models share one window specification.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.functions.signal import make_signal
from tidemark.functions.ts import sma


@dataclass(frozen=True)
class Model:
    build: Callable[[], Column]
    horizon: str
    battery: bool = False


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(ts.col(a), ts.col(b))


def since(k: int) -> Column:
    """Close over its value ``k`` rows ago, less one; over the shared columns."""
    return F.try_divide("close", f"lag_{k}") - 1


def zscore_20() -> Column:
    return (F.col("close") - F.col("sma_20")) / (F.col("sd_20") + 1e-9)


def rsi_14() -> Column:
    return 100 - 100 / (1 + F.col("up_14") / (F.col("down_14") + 1e-9))


def _momentum() -> Column:
    return F.when(F.col("n") >= 131, F.tanh(3 * since(125)))


def _channel() -> Column:
    hi, lo = F.col("hi_20"), F.col("lo_20")
    return F.when(hi == lo, 0.0).otherwise(2 * (F.try_divide(F.col("close") - lo, hi - lo) - 0.5))


def _trend() -> Column:
    legs = F.array_compact(F.array(*[F.when(F.col("n") > k, F.signum(since(k - 1))) for k in (21, 63, 126, 252)]))
    return F.when(F.size(legs) > 0, F.aggregate(legs, F.lit(0.0), lambda a, x: a + x) / F.size(legs))


def _multi_ma() -> Column:
    legs = F.array_compact(F.array(*[F.when(F.col(f"sma_{k}").isNotNull(), F.when(F.col("close") > F.col(f"sma_{k}"), 1.0).otherwise(-1.0)) for k in (20, 50, 100, 200)]))
    return F.when(F.size(legs) > 0, F.aggregate(legs, F.lit(0.0), lambda a, x: a + x) / F.size(legs))


def _bollinger() -> Column:
    m, sd = F.col("sma_20"), F.col("sd_20")
    lower = m - 2 * sd
    pctb = (F.col("close") - lower) / ((m + 2 * sd) - lower + 1e-9)
    return F.when(sd == 0, 0.0).otherwise((0.5 - pctb) * 2)


def _stochastic() -> Column:
    hi, lo = F.col("hi_14"), F.col("lo_14")
    return F.when(hi == lo, 0.0).otherwise((50 - 100 * F.try_divide(F.col("close") - lo, hi - lo)) / 35)


def _time_series_momentum() -> Column:
    """Weighted volatility-scaled legs, the longest without its last month, squashed."""
    vol = F.col("rv_63")
    vol = F.when(vol.isNull() | (vol <= 0), 0.10).otherwise(vol)
    legs = ((21, 0, 0.15), (63, 0, 0.25), (126, 0, 0.25), (252, 21, 0.35))
    total, weight = F.lit(0.0), F.lit(0.0)
    for back, skip, w in legs:
        r = F.try_divide(F.col(f"lag_{skip}") if skip else F.col("close"), F.col(f"lag_{back}")) - 1
        ok = (F.col("n") > back + 1) & r.isNotNull()
        total += F.when(ok, w * r / (vol * ((back - skip) / 252) ** 0.5 + 1e-9)).otherwise(0.0)
        weight += F.when(ok, w).otherwise(0.0)
    return F.when(weight > 0, F.tanh(0.6 * F.try_divide(total, weight)))


def _volume_flow() -> Column:
    sign = F.when(F.col("n") > 21, F.signum(since(20))).otherwise(0.0)
    return (ratio("vsma_20", "vsma_100") - 1) * sign


def _vol_regime() -> Column:
    return -(ratio("rv_20", "rv_100") - 1)


MODELS: dict[str, Model] = {
    "momentum": Model(_momentum, "months"),
    "ma_single_200": Model(lambda: (ratio("close", "sma_200") - 1) * 8, "months"),
    "ma_cross_50_200": Model(lambda: (ratio("sma_50", "sma_200") - 1) * 12, "months"),
    "multi_ma": Model(_multi_ma, "weeks"),
    "mean_reversion": Model(lambda: -zscore_20() / 2, "days"),
    "donchian_breakout": Model(_channel, "weeks"),
    "rsi_reversion": Model(lambda: (50 - rsi_14()) / 30, "days"),
    "vol_regime": Model(_vol_regime, "weeks"),
    "trend_following": Model(_trend, "months"),
}

BATTERY: dict[str, Model] = {
    "s151_sma_cross_20_50": Model(lambda: (ratio("sma_20", "sma_50") - 1) * 12, "weeks", True),
    "s151_sma_cross_50_200": Model(lambda: (ratio("sma_50", "sma_200") - 1) * 12, "months", True),
    "s151_roc_63": Model(lambda: F.when(F.col("n") >= 65, F.tanh(3 * since(62))), "months", True),
    "s151_tsmom": Model(_trend, "months", True),
    "s151_price_vs_sma200": Model(lambda: (ratio("close", "sma_200") - 1) * 8, "months", True),
    "s151_zscore_reversion": Model(lambda: -zscore_20() / 2, "days", True),
    "s151_rsi_reversion": Model(lambda: (50 - rsi_14()) / 30, "days", True),
    "s151_bollinger_pctb": Model(_bollinger, "days", True),
    "s151_stochastic": Model(_stochastic, "days", True),
    "s151_donchian_breakout": Model(_channel, "weeks", True),
    "s151_vol_regime": Model(_vol_regime, "weeks", True),
}

#: Models that need the whole series in order; evaluated at the last row.
RECURSIVE = {"s151_ema_cross_12_26": "weeks", "s151_macd": "weeks", "s151_keltner": "weeks"}

HISTORY_MODELS: dict[str, Callable[[], Column]] = {
    "frm_ts_mom": _time_series_momentum,
    "strat_trend": _trend,
    "strat_momentum": _momentum,
    "strat_ma_cross": MODELS["ma_cross_50_200"].build,
    "strat_ma_200": MODELS["ma_single_200"].build,
}


def evaluate(bars: DataFrame, models: dict[str, Model], *, last_only: bool = True) -> DataFrame:
    """asset, d and one raw column for each model, on every row or on each asset's last."""
    rows = ts.featured_last(bars) if last_only else ts.featured(bars)
    return rows.select("asset", "d", *[m.build().alias(k) for k, m in models.items()])


def long(wide: DataFrame, names: list[str]) -> DataFrame:
    """asset, d, family, raw; undefined values are kept as null."""
    return wide.unpivot(["asset", "d"], names, "family", "raw")


def recursive(bars: DataFrame) -> DataFrame:
    """asset, d and the exponential models at the last row: one fold over each asset's closes."""
    rows = ts.prepared(bars).withColumn("atr", sma("tr", 20))
    s = rows.groupBy("asset").agg(F.max("d").alias("d"), F.sort_array(F.collect_list(F.struct("d", "close"))).alias("s"), F.max_by("atr", "d").alias("atr"))
    s = s.withColumn("c", F.transform("s", lambda x: x["close"])).select("asset", "d", "atr", F.element_at("c", -1).alias("close"), ts.macd_fold(F.col("c")).alias("m"), ts.ema_fold(F.col("c"), (20,))["e20"].alias("e20"))
    return s.select(
        "asset", "d",
        ((ratio("m.e12", "m.e26") - 1) * 12).alias("s151_ema_cross_12_26"),
        ((F.col("m.e12") - F.col("m.e26") - F.col("m.sig")) / (0.01 * F.col("close") + 1e-9)).alias("s151_macd"),
        F.try_divide(F.col("close") - F.col("e20"), 2 * F.col("atr")).alias("s151_keltner"),
    )


def exponential_history(bars: DataFrame) -> DataFrame:
    """asset, d and the exponential models on every row; the signal line averages the two averages' difference."""
    e = ts.ema_columns(bars).withColumn("diff", F.col("e12") - F.col("e26"))
    # the signal line is seeded by the first difference, which is 0
    line = ts.ema_columns(e, (9,), "diff").select("asset", "d", F.col("e9").alias("sig"))
    atr = ts.prepared(bars).select("asset", "d", sma("tr", 20).alias("atr"))
    rows = e.join(line, ["asset", "d"]).join(atr, ["asset", "d"])
    return rows.select("asset", "d", ((ratio("e12", "e26") - 1) * 12).alias("s151_ema_cross_12_26"), ((F.col("diff") - F.col("sig")) / (0.01 * F.col("close") + 1e-9)).alias("s151_macd"), F.try_divide(F.col("close") - F.col("e20"), 2 * F.col("atr")).alias("s151_keltner"))


def signals(bars: DataFrame, tags: DataFrame) -> DataFrame:
    """All per-series signals and the exponential ones as records; tags are a small dimension."""
    every = MODELS | BATTERY
    wide = evaluate(bars, every)
    rows = long(wide, list(every)).unionByName(long(recursive(bars), list(RECURSIVE)))
    horizon = {k: m.horizon for k, m in every.items()} | RECURSIVE
    h = F.create_map(*[F.lit(x) for kv in horizon.items() for x in kv])
    rows = rows.join(tags.select("asset", F.col("grp").alias("cls")), "asset", "left")
    base = dict(segment="strategies", signal=F.col("raw"), family=F.col("family"), horizon=h[F.col("family")], asof=F.col("d"), asset=F.col("asset"), asset_class=F.coalesce("cls", F.lit("equity")), source="bars")
    mine, battery = rows.where(~F.col("family").startswith("s151_")), rows.where(F.col("family").startswith("s151_"))
    return make_signal(mine, **base).unionByName(make_signal(battery, **base, confidence="low"))


def volume_flow(bars: DataFrame) -> DataFrame:
    return evaluate(bars, {"etf_volume_flow_proxy": Model(_volume_flow, "weeks")})
