"""Direction and value tests on synthetic ramps."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.functions.signal import confidence_of, is_valid, make_signal, state_of
from tidemark.operators import ensemble, evaluation, models, performance, rotation


def business_days(n):
    d, out = date(2024, 1, 1), []
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


def ramp(asset, n=300, slope=0.5, spike=1.0):
    rows = []
    for i, d in enumerate(business_days(n)):
        c = (100 + slope * i) * (spike if i == n - 1 else 1.0)
        rows.append((asset, d, c, c * 1.01, c * 0.99, c, 1e6))
    return rows


def bars(spark, *rows):
    return spark.createDataFrame([r for x in rows for r in x], "asset string, d date, open double, high double, low double, close double, volume double")


def tags(spark, *rows):
    return spark.createDataFrame(list(rows), "asset string, label string, region string, grp string")


def test_scalars(spark):
    df = spark.createDataFrame([(5.0,), (-5.0,), (0.0,), (0.2,), (-0.2,), (float("nan"),), (None,)], "x double")
    rows = df.select(ts.clip(F.col("x")).alias("c"), state_of(F.col("x")).alias("s")).collect()
    assert [r["c"] for r in rows] == [1.0, -1.0, 0.0, 0.2, -0.2, 0.0, 0.0]
    assert [r["s"] for r in rows[:5]] == ["buy", "sell", "neutral", "buy", "sell"]
    conf = spark.createDataFrame([(0.05, None), (0.7, None), (0.4, None), (0.4, 0.95), (0.1, 0.95)], "x double, p double").select(confidence_of(F.col("x"), F.col("p")).alias("c")).collect()
    assert [r["c"] for r in conf] == ["low", "high", "medium", "high", "low"]


def test_ramp_directions(spark):
    m = models.evaluate(bars(spark, ramp("A")), models.MODELS).first()
    assert m["momentum"] > 0.3 and m["ma_cross_50_200"] > 0 and m["trend_following"] > 0.5 and m["donchian_breakout"] > 0.5
    assert models.evaluate(bars(spark, ramp("A", spike=1.5)), models.MODELS).first()["mean_reversion"] < 0


def test_short_history_is_zero(spark):
    s = models.signals(bars(spark, ramp("A", n=5)), tags(spark, ("A", "l", "r", "g"))).where("family = 'momentum'").first()
    assert s["signal"] == 0.0 and s["state"] == "neutral"


def test_battery_is_valid(spark):
    s = models.signals(bars(spark, ramp("SPY")), tags(spark, ("SPY", "l", "r", "broad")))
    assert s.where(~is_valid()).count() == 0
    b = s.where("family like 's151_%'")
    assert b.count() == 14 and b.where("confidence <> 'low'").count() == 0
    assert b.where("family = 's151_tsmom'").first()["signal"] > 0.5


def test_ema_matches_loop(spark):
    b = bars(spark, ramp("A", n=60, spike=1.3))
    closes = [r[5] for r in ramp("A", n=60, spike=1.3)]

    def ema(xs, n):
        out = [xs[0]]
        for x in xs[1:]:
            out.append(x * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
        return out

    e12, e26 = ema(closes, 12), ema(closes, 26)
    macd = [a - b for a, b in zip(e12, e26)]
    want = (macd[-1] - ema(macd, 9)[-1]) / (0.01 * closes[-1] + 1e-9)
    got = models.recursive(b).first()
    assert got["s151_macd"] == pytest.approx(want, abs=1e-9)
    assert got["s151_ema_cross_12_26"] == pytest.approx((e12[-1] / e26[-1] - 1) * 12, abs=1e-9)


def test_rotation_ranks(spark):
    b = bars(spark, ramp("VLUE", slope=1.0), ramp("MTUM", slope=0.1), ramp("QUAL", slope=0.5), ramp("ITA", slope=0.5))
    t = tags(spark, ("VLUE", "v", "US", "style"), ("MTUM", "m", "US", "style"), ("QUAL", "q", "US", "style"), ("ITA", "i", "US", "industry"))
    r = {x["asset"]: x for x in rotation.factor_rotation(b, t).collect()}
    assert r["VLUE"]["frm_ts_mom"] > 0
    assert r["VLUE"]["frm_cs_region"] == pytest.approx(1.0) and r["QUAL"]["frm_cs_region"] == pytest.approx(1 / 3) and r["MTUM"]["frm_cs_region"] == pytest.approx(-1 / 3)
    assert r["ITA"]["frm_cs_region"] == 0.0


def test_overlap_and_consensus(spark):
    def sig(asset, family, segment, x, h="weeks"):
        return (asset, family, segment, x, h)

    rows = [sig("AAA", "momentum", "strategies", 0.8), sig("AAA", "rs_long", "themes", 0.6), sig("AAA", "x", "flows", 0.4), sig("BBB", "momentum", "strategies", -0.7)]
    df = spark.createDataFrame(rows, "asset string, family string, segment string, x double, h string")
    s = df.select(F.current_date().alias("d"), "*")
    out = None
    for seg in ("strategies", "themes", "flows"):
        part = make_signal(s.where(F.col("segment") == seg), segment=seg, signal=F.col("x"), family=F.col("family"), horizon=F.col("h"), asof=F.col("d"), asset=F.col("asset"), asset_class=F.lit("equity"), source="t")
        out = part if out is None else out.unionByName(part)
    o = {r["asset"]: r for r in ensemble.overlap(out, "asof").collect()}
    assert o["AAA"]["buy_count"] == 3 and o["AAA"]["n_segments"] == 3 and o["AAA"]["net"] > 0
    assert o["BBB"]["sell_count"] == 1
    c = {r["asset"]: r for r in ensemble.consensus(out).collect()}
    assert c["AAA"]["state"] == "buy" and c["AAA"]["signal_variety"] == 3 and c["AAA"]["entropy"] == 0
    with pytest.raises(ValueError):
        make_signal(s, segment="nope", signal=F.col("x"), family=F.col("family"), horizon=F.col("h"), asof=F.col("d"), asset=F.col("asset"), asset_class=F.lit("e"), source="t")


def test_split_consensus_entropy(spark):
    rows = [("Z", f"f{i}", "strategies", 0.9 if i < 3 else -0.9, "days", "buy" if i < 3 else "sell", "c") for i in range(6)]
    s = spark.createDataFrame(rows, "asset string, family string, segment string, signal double, horizon string, state string, asset_class string")
    assert ensemble.consensus(s).first()["entropy"] == pytest.approx(0.631)


def test_hit_rate_ramp(spark):
    h = evaluation.hit_rate(bars(spark, ramp("A", n=600)), tags(spark, ("A", "l", "r", "g"))).where("model = 'strat_trend' and horizon = '1m' and grp = 'all'").first()
    assert h["n"] > 0 and h["hit_rate"] > 0.9


def test_ar1(spark):
    import random

    rnd = random.Random(0)
    rows = []
    for name, phi in (("up", 0.3), ("down", -0.3)):
        x = 0.0
        for i in range(400):
            x = phi * x + rnd.gauss(0, 1)
            rows.append((name, "R", date(1990 + i // 12, i % 12 + 1, 1), x))
    a = {r["factor"]: r for r in evaluation.ar1(spark.createDataFrame(rows, "factor string, region string, m date, r double")).collect()}
    assert a["up"]["ar1"] > 0 and abs(a["up"]["t_stat"]) > 1.96 and a["down"]["ar1"] < 0


def test_performance(spark):
    b = bars(spark, ramp("A", n=900), ramp("B", n=40))
    r = {x["asset"]: x for x in performance.returns_table(b).collect()}
    assert r["A"]["w1"] > 0 and r["A"]["y3"] is not None and r["B"]["y3"] is None and r["A"]["last"] == round(100 + 0.5 * 899, 2)
    assert performance.breadth(b).first()["n"] == 1
    assert performance.sparkline(b).where("asset = 'A'").count() <= 63


def test_talking_points(spark):
    o = spark.createDataFrame([("SPY", 500.0, 0.012, 0.03), ("^VIX", 14.0, -0.1, 0.0), ("GLD", 200.0, None, None)], "asset string, last double, w1 double, m1 double")
    s = spark.createDataFrame([("Tech", 0.02), ("Energy", -0.01)], "label string, w1 double")
    lines = [r["sentence"] for r in performance.talking_points(o, s, {"curve_10y": 4.2, "above_50": 0.61, "above_200": 0.5, "gex_bn": 1.0, "gex_regime": "positive (vol-dampening)"}).orderBy("n").collect()]
    text = " ".join(lines)
    assert len(lines) >= 5 and "S&P 500 +1.2%" in text and "Tech led" in text and "VIX at 14.0 (calm)" in text and "n/a" in text


def test_one_exchange_for_all_models(spark):
    plan = models.evaluate(bars(spark, ramp("A", n=10)), models.MODELS | models.BATTERY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
