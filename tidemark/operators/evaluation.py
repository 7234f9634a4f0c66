"""Walk-forward history, directional hit-rates and factor-momentum statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.functions.ts import clip
from tidemark.functions.xs import peer_score
from tidemark.operators.models import HISTORY_MODELS, _time_series_momentum

# Forward horizons in bars.
HORIZONS = {"1m": 21, "3m": 63, "6m": 126, "12m": 252}


def walk_forward(bars: DataFrame, *, first: int = 253, step: int = 21) -> DataFrame:
    """asset, d, model, signal, and the forward return at each horizon, on evaluation rows only.

    Trailing windows see no later row, so a model's column is its walk-forward
    value; no prefix is computed twice.
    """
    rows = ts.running(bars)
    ahead = {h: F.lead("close", k).over(ts.series()) for h, k in HORIZONS.items()}
    wide = rows.select("*", *[x.alias(f"_{h}") for h, x in ahead.items()])
    due = wide.where((F.col("n") - 1 >= first) & ((F.col("n") - 1 - first) % step == 0))
    forward = [F.when(F.col("close") > 0, F.try_divide(f"_{h}", "close") - 1).alias(f"f_{h}") for h in HORIZONS]
    due = due.select("asset", "d", *forward, *[clip(m()).alias(k) for k, m in HISTORY_MODELS.items()])
    return due.unpivot(["asset", "d", *[f"f_{h}" for h in HORIZONS]], list(HISTORY_MODELS), "model", "signal")


def hit_rate(bars: DataFrame, tags: DataFrame, *, least: float = 0.05) -> DataFrame:
    """model, grp ('all' for the total, 'other' without a tag), horizon, hits, n, hit_rate: one aggregation with grouping sets."""
    w = walk_forward(bars).where(F.abs("signal") >= least)
    long = w.unpivot(["asset", "model", "signal"], [F.col(f"f_{h}").alias(h) for h in HORIZONS], "horizon", "f").where("f is not null and f <> 0")
    # counted by asset first, so that the join with the tags is of few rows
    counts = long.groupBy("asset", "model", "horizon").agg(F.count_if((F.col("signal") > 0) == (F.col("f") > 0)).alias("hit"), F.count(F.lit(1)).alias("k"))
    j = counts.join(tags.select("asset", "grp"), "asset", "left").withColumn("grp", F.coalesce("grp", F.lit("other")))
    g = j.groupingSets([[F.col("model"), F.col("horizon")], [F.col("model"), F.col("horizon"), F.col("grp")]], F.col("model"), F.col("horizon"), F.col("grp")).agg(F.sum("hit").alias("hits"), F.sum("k").alias("n"), F.grouping("grp").alias("all_"))
    return g.select("model", F.when(F.col("all_") == 1, "all").otherwise(F.col("grp")).alias("grp"), "horizon", "hits", "n", F.round(F.try_divide("hits", "n"), 3).alias("hit_rate"))


def signal_history(bars: DataFrame, tags: DataFrame, *, first: int = 253, step: int = 21, least: int = 253, digits: int | None = 4) -> DataFrame:
    """date, asset, family, signal: factor rotation on every ``step``-th day of the union calendar.

    The calendar is that of all tagged assets with ``least`` bars. On an evaluation
    day each asset stands at its last bar up to then, if it has ``least`` of them, and
    is ranked among its peers of that day. The evaluation days are one short array,
    in proportion to the years, not to the assets.
    """
    tagged = bars.join(tags.select("asset"), "asset", "left_semi")
    size = F.count(F.lit(1)).over(Window.partitionBy("asset"))
    rows = ts.running(tagged).withColumn("size", size).withColumn("next", F.lead("d").over(ts.series())).where(F.col("size") >= least)
    days = tagged.groupBy("asset").agg(F.collect_set("d").alias("days")).where(F.size("days") >= least).select(F.explode("days").alias("d")).distinct()
    day = F.array_sort(F.collect_set("d"))
    due = days.agg(day.alias("all")).select(F.filter("all", lambda _, i: (i >= first) & ((i - first) % step == 0)).alias("due"))
    here = F.filter("due", lambda e: (e >= F.col("d")) & (F.col("next").isNull() | (e < F.col("next"))))
    r12 = F.when(F.col("n") >= 254, F.try_divide("lag_21", "lag_252") - 1)
    at = rows.where(F.col("n") >= least).crossJoin(F.broadcast(due)).withColumn("here", here).where(F.size("here") > 0)
    at = at.select("asset", F.explode("here").alias("date"), clip(_time_series_momentum()).alias("ts"), r12.alias("r12")).join(tags, "asset")
    x = at.withColumn("cs", peer_score("r12", ["date", "grp", "region"])).withColumn("peer", peer_score("r12", ["date", "grp", "label"]))
    places = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    composite = clip(0.6 * F.col("ts") + 0.3 * F.col("cs") + 0.1 * F.col("peer"))
    out = x.select("date", "asset", places(F.col("ts")).alias("frm_ts_mom"), places(F.col("cs")).alias("frm_cs_region"), places(composite).alias("frm_composite"))
    return out.unpivot(["date", "asset"], ["frm_ts_mom", "frm_cs_region", "frm_composite"], "family", "signal")


def _series() -> Window:
    return Window.partitionBy("factor").orderBy("m")


def ar1(returns: DataFrame, *, least: int = 24) -> DataFrame:
    """Slope and t-statistic of each factor's return on its previous one; n is the number of pairs."""
    pairs = returns.withColumn("x", F.lag("r").over(_series())).where("x is not null")
    x, y = F.col("x"), F.col("r")
    g = pairs.groupBy("factor", "region").agg(F.count(F.lit(1)).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")).where(F.col("n") + 1 >= least)
    b = F.try_divide("sxy", "sxx")
    g = g.withColumn("b", b)
    se = F.sqrt(F.try_divide(F.greatest((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2), F.lit(0.0)), F.col("sxx")))
    return g.select("factor", "region", F.coalesce("b", F.lit(0.0)).alias("ar1"), F.when(F.col("sxx") == 0, 0.0).otherwise(F.try_divide(F.col("b"), se)).alias("t_stat"), (F.col("n") + 1).alias("n_months"))


def ts_strategy(returns: DataFrame, back: int = 12) -> DataFrame:
    """factor, region, m, s: the month's return times the sign of the sum of the ``back`` months before."""
    before = _series().rowsBetween(-back, -1)
    total = F.when(F.count("r").over(before) == back, F.sum("r").over(before))
    return returns.select("factor", "region", "m", (F.signum(total) * F.col("r")).alias("s")).where("s is not null")


def sharpe(strategy: DataFrame, by: list[str], value: str = "s", least: int = 12) -> DataFrame:
    g = strategy.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return g.select(*by, F.when((F.col("n") >= least) & (F.col("sd") != 0), F.try_divide("mean", "sd") * F.sqrt(F.lit(12.0))).alias("sharpe"), "n")


def equal_vol(strategy: DataFrame) -> DataFrame:
    """m, s: mean over factors of their returns scaled to unit volatility; a flat factor weighs 0."""
    sd = F.stddev_samp("s").over(Window.partitionBy("factor"))
    w = F.when(sd > 0, 1 / sd).otherwise(0.0)
    return strategy.select("m", (F.col("s") * w).alias("s")).groupBy("m").agg(F.avg("s").alias("s"))


def backtest_summary(returns: DataFrame) -> DataFrame:
    """n_factors, n_positive, n_significant and the Sharpe ratio of the combined strategy."""
    a = ar1(returns)
    counts = a.agg(F.count(F.lit(1)).alias("n_factors"), F.count_if(F.col("ar1") > 0).alias("n_positive"), F.count_if((F.col("ar1") > 0) & (F.abs("t_stat") > 1.96)).alias("n_significant"))
    combined = sharpe(equal_vol(ts_strategy(returns)).withColumn("k", F.lit(1)), ["k"]).select(F.col("sharpe").alias("combined_sharpe"))
    return counts.crossJoin(F.broadcast(combined))
