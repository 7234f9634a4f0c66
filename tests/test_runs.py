from tidemark.plans import runs
from tidemark.sources import adapters, universe
from tests.test_signals import bars, ramp


def test_universe(spark):
    c = {r["asset"]: r["asset_class"] for r in universe.core(spark).collect()}
    assert len(c) == 53 and c["XLK"] == "sector" and c["SPY"] == "factor" and c["TLT"] == "macro"
    more = spark.createDataFrame([("VLUE", "beta", "x", "US"), ("NEW", "beta", "x", "US")], "asset string, grp string, label string, region string")
    t = {r["asset"]: r["grp"] for r in universe.peer_tags(spark, more).collect()}
    assert len(t) == 32 and t["VLUE"] == "style" and t["NEW"] == "beta"
    out = universe.labelled(spark.createDataFrame([("GLD",), ("ZZZ",)], "asset string"), universe.core(spark)).collect()
    assert {(r["label"], r["asset_class"]) for r in out} == {("Gold", "theme"), ("ZZZ", "equity")}


def test_signal_run(spark, sf):
    b, t = adapters.daily_bars(spark, sf), adapters.supplier_tags(spark, sf)
    run = runs.signal_run(b, t, benchmark=1, today="2026-03-02", cadence="monthly", series=adapters.macro(spark, sf), vix="click", credit="view", positions=adapters.positioning(spark, sf), factor_returns=adapters.factor_returns(spark, sf))
    assert all(ok for _, ok, _ in run.status), run.status
    s = run.tables["signals"]
    assert {r["segment"] for r in s.select("segment").distinct().collect()} == {"strategies", "themes", "factor_rotation", "flows", "rebalance", "regime"}
    assert run.tables["scenarios"].count() == 5 and run.tables["backtest"].count() == 1


def test_failing_part_is_told():
    run = runs.Run()
    run.part("bad", lambda: 1 / 0)
    assert run.status == [("bad", False, "ZeroDivisionError: division by zero")]


def test_feed_run(spark):
    e = spark.createDataFrame([(1, "s", "http://a.com/1", "One", "<p>x</p>", None, None, None), (2, "s", "http://a.com/1#f", "One", "", None, None, None), (3, "s", "http://a.com/2", "Two", "<img src=x>", None, None, None)], "seq long, source string, link string, title string, summary string, media boolean, enclosure string, page string")
    run = runs.feed_run(e, spark.createDataFrame([], "id string"))
    new = {r["seq"]: r["visual"] for r in run.tables["new"].collect()}
    assert new == {1: "text", 3: "visual"} and run.tables["seen"].count() == 2
    again = runs.feed_run(e, run.tables["seen"], run.tables["archive"])
    assert again.tables["new"].count() == 0 and again.tables["archive"].count() == 2


def test_brief_run(spark):
    b = bars(spark, ramp("SPY"), ramp("XLK", slope=1.0), ramp("XLE", slope=0.1))
    g = spark.createDataFrame([("SPY", "equity", "S&P 500"), ("XLK", "sector", "Technology"), ("XLE", "sector", "Energy")], "asset string, grp string, label string")
    t = spark.createDataFrame([("XLK", "l", "US", "style")], "asset string, label string, region string, grp string")
    run = runs.brief_run(b, g, t)
    assert all(ok for _, ok, _ in run.status), run.status
    assert [r["label"] for r in run.tables["sectors"].collect()] == ["Technology", "Energy"]
    assert any("Technology led" in r["sentence"] for r in run.tables["talking_points"].collect())
