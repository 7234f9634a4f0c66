"""Multi-horizon returns, breadth, movers, spark lines, rebased panels, talking points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.functions.text import percent
from tidemark.functions.ts import change

# Horizons in bars; the sentences of the brief are fixed texts too.
HORIZONS = {"w1": 5, "m1": 21, "m3": 63, "m6": 126, "y1": 252, "y3": 756}


def cents(c: str):
    """To two places; the nudge settles ties the same way in any engine."""
    return F.round(F.col(c) + 1e-9, 2)


def returns_table(bars: DataFrame, horizons: dict[str, int] = HORIZONS, digits: int = 4) -> DataFrame:
    """Last close and its change over each horizon; null where the history is shorter."""
    rows = ts.prepared(bars).select("asset", "d", "close", *[change("close", k).alias(h) for h, k in horizons.items()], ts.is_last().alias("_last"))
    return rows.where("_last").select("asset", "d", cents("close").alias("last"), *[F.round(h, digits).alias(h) for h in horizons])


def year_to_date(bars: DataFrame) -> DataFrame:
    """Last close over the first one of its calendar year; null with under two rows in it."""
    year = F.year("d")
    by_year = bars.groupBy("asset", year.alias("y")).agg(F.min_by("close", "d").alias("first"), F.max_by("close", "d").alias("last"), F.count(F.lit(1)).alias("n"))
    latest = by_year.groupBy("asset").agg(F.max_by(F.struct("first", "last", "n"), "y").alias("x"))
    return latest.select("asset", F.when(F.col("x.n") >= 2, F.try_divide("x.last", "x.first") - 1).alias("ytd"))


def breadth(bars: DataFrame, least: int = 60) -> DataFrame:
    """Number of assets of ``least`` bars, and the shares of all of them above their averages."""
    last = ts.featured_last(bars).where(F.col("n") >= least).select("close", F.col("sma_50").alias("s50"), F.col("sma_200").alias("s200"))
    return last.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if(F.col("close") > F.col("s50")), F.count(F.lit(1))).alias("pct_above_50dma"), F.try_divide(F.count_if(F.col("close") > F.col("s200")), F.count(F.lit(1))).alias("pct_above_200dma"))


def movers(table: DataFrame, by: str = "w1", k: int = 5) -> DataFrame:
    """The k largest and smallest: two top-k plans, no full sort."""
    rows = table.where(F.col(by).isNotNull())
    up = rows.orderBy(F.desc(by), "asset").limit(k).withColumn("side", F.lit("up"))
    return up.unionByName(rows.orderBy(F.asc(by), "asset").limit(k).withColumn("side", F.lit("down")))


def sparkline(bars: DataFrame, tail: int = 126, points: int = 40) -> DataFrame:
    """asset, d, close: every step-th of the last ``tail`` bars, at least one a step."""
    desc = Window.partitionBy("asset").orderBy(F.desc("d"))
    cut = bars.select("asset", "d", "close", F.row_number().over(desc).alias("k")).where(F.col("k") <= tail)
    n = F.count(F.lit(1)).over(Window.partitionBy("asset"))
    step = F.greatest(F.lit(1), F.floor(n / points))
    return cut.select("asset", "d", cents("close").alias("close"), ((n - F.col("k")) % step).alias("r")).where("r = 0").drop("r")


def price_panel(bars: DataFrame, points: int = 90, least: int = 4) -> DataFrame:
    """Parallel arrays d and c of every step-th bar from the first; series of under ``least`` points are dropped."""
    n, k = F.count(F.lit(1)).over(Window.partitionBy("asset")), F.row_number().over(ts.series()) - 1
    rows = bars.select("asset", "d", "close", (k % F.greatest(F.lit(1), F.floor(n / points))).alias("r")).where("r = 0")
    g = rows.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("d", cents("close").alias("c")))).alias("x")).where(F.size("x") >= least)
    return g.select("asset", F.transform("x", lambda e: e["d"]).alias("d"), F.transform("x", lambda e: e["c"]).alias("c"))


def rebased(bars: DataFrame, tail: int = 252) -> DataFrame:
    """Change since the first of the last ``tail`` bars."""
    desc = Window.partitionBy("asset").orderBy(F.desc("d"))
    cut = bars.select("asset", "d", "close", F.row_number().over(desc).alias("k")).where(F.col("k") <= tail)
    return cut.select("asset", "d", (F.try_divide("close", F.first("close").over(ts.series().rowsBetween(Window.unboundedPreceding, 0))) - 1).alias("rebased"))


def comparative(bars: DataFrame, window: int | str, today: str, hourly: DataFrame | None = None) -> DataFrame:
    """asset, d, pct: change in percent since the start of a window of ``window`` bars, or of the year ('YTD').

    A window of at most six bars shows ``hourly`` (asset, d, close) whole, where that is
    given. Series of under two rows or without a first price are left out.
    """
    if window == "YTD":
        rows = bars.where(F.col("d") >= F.trunc(F.to_date(F.lit(today)), "year"))
    elif hourly is not None and window <= 6:
        rows = hourly
    else:
        back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("d")))
        rows = bars.withColumn("_k", back).where(F.col("_k") <= window)
    w = Window.partitionBy("asset")
    rows = rows.select("asset", "d", "close", F.min_by("close", "d").over(w).alias("first"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.where("n >= 2 and first > 0").select("asset", "d", ((F.try_divide("close", "first") - 1) * 100).alias("pct"))


def daily_series(bars: DataFrame, keep: int = 252, digits: int = 4) -> DataFrame:
    """asset, d, c: the last ``keep`` closes that there are."""
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("d")))
    return bars.where("close is not null").withColumn("_k", back).where(F.col("_k") <= keep).select("asset", "d", F.round("close", digits).alias("c"))


def month_seasonality(bars: DataFrame) -> DataFrame:
    """Mean and hit-rate of monthly changes by calendar month."""
    ends = bars.groupBy("asset", F.trunc("d", "month").alias("m")).agg(F.max_by("close", "d").alias("c"))
    r = ends.select("asset", F.month("m").alias("month"), (F.try_divide("c", F.lag("c").over(Window.partitionBy("asset").orderBy("m"))) - 1).alias("r")).where("r is not null")
    return r.groupBy("asset", "month").agg(F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def talking_points(overview: DataFrame, sectors: DataFrame, facts: dict | None = None) -> DataFrame:
    """Sentences of the weekly brief, in order: (n, sentence).

    ``overview`` has asset, last, w1, m1; ``sectors`` label, w1. ``facts`` may hold
    curve_10y, curve_2s10s, target_lower, target_upper, implied_bps,
    above_50, above_200, gex_bn and gex_regime. Both tables are a screenful.
    """
    facts = facts or {}
    pick = lambda a, c: F.max(F.when(F.col("asset") == a, F.col(c)))
    o = overview.agg(*[pick(a, c).alias(f"{n}_{c}") for a, n in (("SPY", "spy"), ("QQQ", "qqq"), ("IWM", "iwm"), ("GLD", "gld"), ("USO", "uso"), ("UUP", "uup"), ("^VIX", "vix")) for c in ("w1", "m1", "last")])
    s = sectors.agg(F.max_by("label", "w1").alias("lead"), F.max("w1").alias("lead_w1"), F.min_by("label", "w1").alias("lag"), F.min("w1").alias("lag_w1"))
    one = o.crossJoin(s)
    p = lambda c: percent(F.col(c))
    mood = F.when(F.col("vix_last") < 16, "calm").when(F.col("vix_last") > 24, "elevated").otherwise("moderate")
    lit = lambda k: F.lit(None if facts.get(k) is None else str(facts[k]))
    share = lambda k: F.lit(None if facts.get(k) is None else f"{facts[k]:.0%}")
    lines = [
        F.when(F.col("spy_last").isNotNull(), F.concat(F.lit("U.S. stocks "), F.when(F.coalesce("spy_w1", F.lit(0.0)) >= 0, "rose").otherwise("fell"), F.lit(" this week — S&P 500 "), p("spy_w1"), F.lit(" (1-month "), p("spy_m1"), F.lit("); Nasdaq "), p("qqq_w1"), F.lit(", small caps "), p("iwm_w1"), F.lit("."))),
        F.when(F.col("lead").isNotNull(), F.concat(F.lit("Sectors: "), F.col("lead"), F.lit(" led ("), p("lead_w1"), F.lit("), "), F.col("lag"), F.lit(" lagged ("), p("lag_w1"), F.lit(")."))),
        F.concat(F.lit("Commodities/FX: gold "), p("gld_w1"), F.lit(", oil "), p("uso_w1"), F.lit(", the dollar "), p("uup_w1"), F.lit(".")),
        F.concat(F.lit("Rates: 10y Treasury at "), lit("curve_10y"), F.lit("%, 2s10s "), F.coalesce(lit("curve_2s10s"), F.lit("?")), F.lit(". Fed funds "), F.coalesce(lit("target_lower"), F.lit("?")), F.lit("–"), F.coalesce(lit("target_upper"), F.lit("?")), F.lit("%; the 1y market implies ~"), F.coalesce(lit("implied_bps"), F.lit("?")), F.lit(" bps over 12m.")),
        F.when(F.col("vix_last").isNotNull(), F.concat(F.lit("Volatility: VIX at "), F.col("vix_last").cast("string"), F.lit(" ("), mood, F.lit("), 1-week "), p("vix_w1"), F.lit("."))),
        F.concat(F.lit("Breadth: "), share("above_50"), F.lit(" of the S&P 500 is above its 50-day average ("), F.coalesce(share("above_200"), F.lit("0%")), F.lit(" above the 200-day).")),
        F.concat(F.lit("Options: SPY dealer gamma is "), lit("gex_regime"), F.lit(" — dealers cushion moves." if (facts.get("gex_bn") or 0) >= 0 else " — moves can accelerate.")),
    ]
    return one.select(F.posexplode(F.array_compact(F.array(*lines))).alias("n", "sentence"))
