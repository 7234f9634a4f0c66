"""Data-quality checks as rows: check, ok, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.signal import is_valid


def checks(df: DataFrame, named: dict[str, tuple[Column, Column]]) -> DataFrame:
    """All checks of a table in one aggregation; each is (condition, detail) over aggregates."""
    one = df.agg(*[c.alias(f"ok{i}") for i, (c, _) in enumerate(named.values())], *[d.cast("double").alias(f"d{i}") for i, (_, d) in enumerate(named.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(f"ok{i}", F.lit(False)).alias("ok"), F.col(f"d{i}").alias("detail")) for i, n in enumerate(named)])).alias("x")).select("x.*")


def signal_checks(signals: DataFrame, least: int = 1000) -> DataFrame:
    bad = F.count_if(~is_valid())
    n = F.count(F.lit(1))
    return checks(signals, {"enough_signals": (n >= least, n), "all_valid": (bad == 0, bad), "high_confidence_reached": (F.count_if(F.col("confidence") == "high") > 0, F.count_if(F.col("confidence") == "high")), "no_null_signal": (F.count_if(F.col("signal").isNull()) == 0, F.count_if(F.col("signal").isNull()))})


def bar_checks(bars: DataFrame, today: str, days: int = 10) -> DataFrame:
    age = F.date_diff(F.to_date(F.lit(today)), F.max("d"))
    dup = F.count(F.lit(1)) - F.count_distinct("asset", "d")
    wrong = F.count_if((F.col("high") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")))
    return checks(bars, {"fresh": (age <= days, age), "no_duplicate_days": (dup == 0, dup), "high_over_low": (wrong == 0, wrong), "positive_close": (F.min("close") > 0, F.min("close"))})


def brief_checks(overview: DataFrame, sectors: DataFrame, movers: DataFrame, earnings: DataFrame, news: DataFrame, asof: str, today: str, *, days: int = 10, most_cap: float = 5e12) -> DataFrame:
    """Checks of the weekly brief: overview (grp, asset, last), sectors (pos, asset, w1), movers (name), earnings (mktcap), news."""
    one = overview.sparkSession.range(1)
    age = F.date_diff(F.to_date(F.lit(today)), F.to_date(F.lit(asof)))
    groups = F.count_distinct(F.when(F.col("grp").isin("equity", "commodity", "bond", "fx"), F.col("grp")))
    no_price = F.count_if(F.col("last").isNull())
    n, lead, lag = F.count(F.lit(1)), F.min_by("w1", F.when(F.col("w1").isNotNull(), F.col("pos"))), F.max_by("w1", F.when(F.col("w1").isNotNull(), F.col("pos")))
    unnamed = F.count_if(F.coalesce("name", F.lit("")) == "")
    absurd = F.count_if(F.col("mktcap") > most_cap)
    return union([
        checks(one, {"brief_fresh": (F.max(age) <= days, F.max(age))}),
        checks(overview, {"overview_groups": (groups == 4, groups), "overview_prices": (no_price == 0, no_price)}),
        checks(sectors, {"sector_count": (n == 11, n), "sectors_sorted": (F.coalesce(lead >= lag, F.lit(True)), lead - lag)}),
        checks(movers, {"movers_named": (unnamed == 0, unnamed)}),
        checks(earnings, {"plausible_market_caps": (absurd == 0, absurd)}),
        checks(news, {"ticker_news_present": (n > 0, n)}),
    ])


def run_checks(status: DataFrame, signals: DataFrame, universe: DataFrame, panel: DataFrame, rotation: DataFrame, hit_rates: DataFrame, today: str, *, benchmark: str = "SPY", named: tuple[str, ...] = ("INDA", "MTUM"), days: int = 10, least: int = 1000, least_rotation: int = 500) -> DataFrame:
    """Checks of a signal run: status (d), signals, universe (asset, grp, label), panel (asset, c), rotation (timeframe), hit_rates (model)."""
    n = F.count(F.lit(1))
    age = F.date_diff(F.to_date(F.lit(today)), F.max("d"))
    high, rotated = F.count_if(F.col("confidence") == "high"), F.count_if(F.col("segment") == "factor_rotation")
    twice = n - F.count_distinct("asset")
    groups = F.count_distinct(F.when(F.col("grp").isin("style", "industry", "beta"), F.col("grp")))
    unresolved = F.count_if(F.col("asset").isin(*named) & (F.coalesce("label", F.col("asset")) == F.col("asset")))
    frames = F.count_distinct(F.when(F.col("timeframe").isin("1m", "3m", "6m", "1y"), F.col("timeframe")))
    of_benchmark = F.count_if((F.col("asset") == benchmark) & (F.size("c") > 0))
    return union([
        checks(status, {"status_present": (n > 0, n), "run_fresh": (age <= days, age)}),
        checks(signals, {"enough_signals": (n > least, n), "high_confidence_reached": (high > 0, high), "enough_rotation_signals": (rotated > least_rotation, rotated)}),
        checks(universe, {"no_duplicate_assets": (twice == 0, twice), "universe_groups": (groups == 3, groups), "labels_resolve": (unresolved == 0, unresolved)}),
        checks(panel, {"price_panel_present": (of_benchmark > 0, of_benchmark)}),
        checks(rotation, {"rotation_frames": (frames == 4, frames)}),
        checks(hit_rates, {"hit_rates_present": (n > 0, n)}),
    ])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
