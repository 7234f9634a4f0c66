"""The three runs: signals, feed, brief. Each builds lazy tables from its inputs.

A part that fails while it is planned leaves the others alone and is told in the
status table. Nothing here acts; the caller writes the tables it wants.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.signal import make_signal
from tidemark.operators import calendar, ensemble, evaluation, feed, macro, models, performance, rotation

# Horizons of the families outside of the model registry.
THEME_HORIZON = {"relative_strength": "months", "rs_short": "weeks", "rs_long": "months", "trend_vs_200dma": "months"}
ROTATION = ("frm_ts_mom", "frm_cs_region", "frm_cs_peer", "frm_composite")


@dataclass
class Run:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    status: list[tuple[str, bool, str]] = field(default_factory=list)

    def part(self, name: str, build) -> None:
        try:
            self.tables[name] = build()
            self.status.append((name, True, ""))
        except Exception as e:  # one segment must not stop the run; the reason is kept
            self.status.append((name, False, f"{type(e).__name__}: {str(e)[:200]}"))


def _long(wide: DataFrame, families: dict[str, str], segment: str, source: str) -> DataFrame:
    rows = wide.unpivot(["asset", "d"], list(families), "family", "raw")
    h = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    return make_signal(rows, segment=segment, signal=F.col("raw"), family=F.col("family"), horizon=h[F.col("family")], asof=F.col("d"), asset=F.col("asset").cast("string"), asset_class=F.lit("equity"), source=source)


def signal_run(bars: DataFrame, tags: DataFrame, *, benchmark, today: str, cadence: str = "daily", series: DataFrame | None = None, vix: str = "", credit: str = "", rate: str = "", positions: DataFrame | None = None, factor_returns: DataFrame | None = None) -> Run:
    """All segments, their union, and consensus, overlap and heat-map over it.

    ``bars`` feeds several branches; cache or store it first if reading it is dear.
    Positioning enters weekly and monthly, the backtest monthly. ``vix``, ``credit``
    and ``rate`` name the series of volatility, credit spread and ten-year yield.
    """
    run, spark = Run(), bars.sparkSession
    run.part("strategies", lambda: models.signals(bars, tags).withColumn("asset", F.col("asset").cast("string")))
    run.part("themes", lambda: _long(rotation.relative_strength(bars, benchmark), THEME_HORIZON, "themes", "bars"))
    run.part("factor_rotation", lambda: _long(rotation.factor_rotation(bars, tags), dict.fromkeys(ROTATION, "months"), "factor_rotation", "bars"))
    run.part("alpha", lambda: _long(rotation.alpha_combo(bars).crossJoin(F.broadcast(bars.agg(F.max("d").alias("d")))), {"formulaic_alpha_combo": "days"}, "strategies", "bars"))
    run.part("flows", lambda: _long(models.volume_flow(bars), {"etf_volume_flow_proxy": "weeks"}, "flows", "bars").withColumn("confidence", F.lit("low")))
    if positions is not None and cadence in ("weekly", "monthly"):
        run.part("positioning", lambda: make_signal(macro.positioning_signals(positions), segment="flows", signal=F.col("signal"), family=F.col("family"), horizon=F.lit("weeks"), asof=F.to_date(F.lit(today)), asset=F.col("market"), asset_class=F.lit("macro"), source="reports", percentile=F.col("percentile")))
    dates = calendar.events(spark, today)
    run.tables["calendar"] = dates
    run.part("rebalance", lambda: make_signal(calendar.proximity(dates), segment="rebalance", signal=F.col("signal"), family=F.col("family"), horizon=F.lit("weeks"), asof=F.to_date(F.lit(today)), asset=F.col("asset"), asset_class=F.lit("market"), source="calendar", confidence="medium"))
    if series is not None:
        run.part("regime_summary", lambda: macro.regime(bars, benchmark, series, vix=vix, credit=credit))
        run.part("regime", lambda: make_signal(run.tables["regime_summary"], segment="regime", signal=F.col("risk_score"), family=F.lit("risk_regime"), horizon=F.lit("weeks"), asof=F.to_date(F.lit(today)), asset=F.lit("MARKET"), asset_class=F.lit("market"), source="macro", rationale=F.col("label")))
    segments = [run.tables[k] for k in ("strategies", "themes", "factor_rotation", "alpha", "flows", "positioning", "rebalance", "regime") if k in run.tables]
    if segments:
        every = reduce(DataFrame.unionByName, segments)
        run.tables["signals"] = every
        run.part("consensus", lambda: ensemble.consensus(every))
        run.part("overlap", lambda: ensemble.overlap(every, "asof"))
        run.part("matrix", lambda: ensemble.matrix(every, "asof"))
        run.part("heatmap", lambda: ensemble.heatmap(every, ensemble.top_and_bottom(run.tables["consensus"].select("asset", "composite"), "composite", 15)))
    if "regime_summary" in run.tables and "overlap" in run.tables:
        first = macro.crowded(run.tables["overlap"]).agg(F.max("asset").alias("crowded"))
        soon = dates.agg(F.min("days_until").alias("days_to_event"))
        ten_year = macro.percentile_of_last(series.where(F.col("series_id") == rate)).agg(F.max("percentile").alias("rate_percentile"))
        run.part("scenarios", lambda: macro.scenarios(run.tables["regime_summary"].crossJoin(first).crossJoin(soon).crossJoin(ten_year)))
    run.part("rotation", lambda: rotation.rotation_by_timeframe(bars, tags))
    run.part("history", lambda: evaluation.signal_history(bars, tags))
    run.part("hit_rate", lambda: evaluation.hit_rate(bars, tags))
    if factor_returns is not None and cadence == "monthly":
        run.part("backtest", lambda: evaluation.backtest_summary(factor_returns))
    return run


def feed_run(entries: DataFrame, seen: DataFrame, archive: DataFrame | None = None, *, per_source: int = 25, budget: int = 120) -> Run:
    """Entries (seq, source, category, link, title, summary, published, media, enclosure, page) -> new items, merged day archive, seen ids, status."""
    from tidemark.sources.sinks import merged

    run = Run()
    few = feed.capped(entries, per_source)
    new = feed.unseen(feed.with_ids(few), seen)
    # pages are read for new insights only, so that items seen before spend nothing of the budget
    raw = few.select("seq", "media", "enclosure", F.col("summary").alias("_summary"), "page")
    kinds = feed.classify(new.drop("summary").join(raw, "seq").withColumnRenamed("_summary", "summary"), budget=budget, split="insight")
    items = new.join(kinds.select("seq", F.col("kind").alias("visual")), "seq")
    run.tables["new"] = items
    run.tables["archive"] = merged(archive, items) if archive is not None else items
    run.tables["seen"] = seen.select("id").unionByName(items.select("id")).distinct()
    run.tables["status"] = entries.groupBy("source").agg(F.count(F.lit(1)).alias("total_feed")).join(items.groupBy("source").agg(F.count(F.lit(1)).alias("new")), "source", "left").na.fill({"new": 0})
    return run


def brief_run(bars: DataFrame, groups: DataFrame, tags: DataFrame, *, chain: DataFrame | None = None, series: DataFrame | None = None, facts: dict | None = None) -> Run:
    """``groups``: asset, grp, label in a few display groups, 'sector' among them."""
    run = Run()
    table = performance.returns_table(bars).join(performance.year_to_date(bars), "asset")
    run.tables["overview"] = table.join(groups, "asset")
    sectors = run.tables["overview"].where("grp = 'sector'").orderBy(F.desc_nulls_last("w1"))
    run.tables["sectors"] = sectors
    run.part("sparklines", lambda: performance.sparkline(bars))
    run.part("breadth", lambda: performance.breadth(bars))
    run.part("movers", lambda: performance.movers(table, k=20))
    run.part("rotation", lambda: rotation.rotation_by_timeframe(bars, tags))
    if series is not None:
        run.part("curve", lambda: macro.curve_snapshot(series))
    if chain is not None:
        run.part("gex", lambda: macro.net_gamma(chain))
    run.part("talking_points", lambda: performance.talking_points(table.select("asset", "last", "w1", "m1"), sectors.select("label", "w1"), facts))
    return run
