"""Readers of files, sinks, gates, sorted views, checks and gauges on small hand-made tables."""

import io
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.test_signals import bars, ramp
from tidemark.functions import text as tx
from tidemark.functions import ts
from tidemark.functions.options import bs_gamma
from tidemark.operators import calendar, ensemble, evaluation, feed, macro, models, performance, quality, registry, views
from tidemark.plans import runs
from tidemark.sources import readers, sinks
from tidemark.streaming import streams


def workbook(path, sheet, rows):
    """A workbook as the format has it: shared strings, numbers, and cells left out."""
    words, body = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for k, x in enumerate(row):
            ref = f"{chr(65 + k)}{i}"
            if isinstance(x, str):
                words.append(x)
                cells.append(f'<c r="{ref}" t="s"><v>{len(words) - 1}</v></c>')
            elif x is not None:
                cells.append(f'<c r="{ref}"><v>{x}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Notes" sheetId="1"/><sheet name="{sheet}" sheetId="2"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{w}</t></si>" for w in words) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")


def test_factor_workbook(spark, tmp_path):
    path = str(tmp_path / "f.xlsx")
    rows = [["A note"], ["Another"], ["DATE", "USA", "Nowhere", "Japan"]]
    rows += [[f"{1 + k % 12}/28/{2000 + k // 12}", 0.01 * k, 1.0, 0.5 if k < 24 else None] for k in range(30)]
    rows += [[41670, 0.9, 1.0, None]]  # a day number: the first month of 2014
    workbook(path, "QMJ Factors", rows)
    cells = readers.sheet_cells(spark, path, "QMJ Factors")
    got = readers.factor_sheet(spark, cells, {"USA": "US", "Japan": "JP"}, "QMJ")
    assert {(r["factor"], r["region"]) for r in got.select("factor", "region").distinct().collect()} == {("US:QMJ", "US")}
    assert got.count() == 31 and got.where("m = date'2014-01-01'").first()["r"] == 0.9
    assert readers.sheet_cells(spark, path, "none") == [] and readers.factor_sheet(spark, [["a"], ["b"]]).count() == 0


def test_constituents_of_a_page(spark):
    html = "<p>x</p><table><tr><th>Symbol</th><th>Security</th></tr><tr><td>BRK.B</td><td>Berkshire <b>Hathaway</b><sup>1</sup></td></tr><tr><td>A</td><td>Agilent</td></tr><tr><td>A</td><td>Agilent</td></tr></table><table><tr><td>no</td></tr></table>"
    got = readers.constituents(readers.first_table(spark, html)).collect()
    assert {(r["symbol"], r["name"]) for r in got} == {("BRK-B", "Berkshire Hathaway"), ("A", "Agilent")}
    assert readers.first_table(spark, "<p>none</p>").count() == 0


def test_feeds_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>One</title><link>http://a.com/1</link><description>s</description><pubDate>d1</pubDate></item></channel></rss>")
    (tmp_path / "b.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two</title><link rel="self" href="http://b.com/self"/><link rel="alternate" href="http://b.com/2"/><summary>t</summary><updated>d2</updated></entry><entry><title>Three</title><link href="http://b.com/3"/><content>u</content><published>d3</published></entry></feed>')
    got = {tuple(r) for r in readers.landed_feed(spark, str(tmp_path)).collect()}
    assert got == {("One", "http://a.com/1", "s", "d1"), ("Two", "http://b.com/2", "t", "d2"), ("Three", "http://b.com/3", "u", "d3")}


def test_positions_file(spark, tmp_path):
    lines = [f'{{"market_and_exchange_names": "Gold - Comex", "report_date_as_yyyy_mm_dd": "2024-01-{d:02d}T00:00:00", "dealer_positions_long_all": "{d}", "dealer_positions_short_all": "1", "open_interest_all": "9"}}' for d in (2, 9, 16)]
    (tmp_path / "c.json").write_text("\n".join(lines))
    got = readers.cot_json(spark, str(tmp_path / "c.json"), ["GOLD", "SILVER"], weeks=2).collect()
    assert {(r["market"], r["d"], r["dealer_net"], r["mgd_money_net"]) for r in got} == {("GOLD", date(2024, 1, 9), 8.0, 0.0), ("GOLD", date(2024, 1, 16), 15.0, 0.0)}


def test_panel_cache_and_missing(spark, tmp_path):
    b = bars(spark, ramp("A"), ramp("B"), ramp("C"))
    assert readers.price_panel(b.where("asset <> 'C' or d < '2024-01-20'"), 60).select("asset").distinct().count() == 2
    wanted = spark.createDataFrame([("A",), ("Z",)], "asset string")
    assert sinks.cached(spark, str(tmp_path), "p") is None
    sinks.save(b.where("asset = 'A'"), str(tmp_path), "p")
    held, missing = readers.prices(spark, str(tmp_path), "p", wanted)
    assert [r["asset"] for r in held.select("asset").distinct().collect()] == ["A"] and [r["asset"] for r in missing.collect()] == ["Z"]
    assert sinks.cached(spark, str(tmp_path), "p", max_age_hours=-1) is None
    none, missing = readers.prices(spark, str(tmp_path), "q", wanted)
    assert none is None and missing.count() == 2


def test_sources_and_gates(spark):
    f = spark.createDataFrame([("u", "crawl", "c"), ("u", "direct", ""), ("u", "render", "r"), ("v", "direct", None)], "url string, via string, html string")
    assert [tuple(r) for r in readers.first_way(f).collect()] == [("u", "r", "render")]
    urls = spark.createDataFrame([("https://A.com/x",), ("https://b.com/x",), ("https://c.com/x",)], "url string")
    rules = spark.createDataFrame([("a.com", False), ("b.com", True)], "host string, allowed boolean")
    assert {r["url"] for r in readers.allowed(urls, rules).collect()} == {"https://b.com/x", "https://c.com/x"}
    usage = lambda *rows: spark.createDataFrame(rows, "discounted string, plain string")
    assert readers.spent(usage(("1.5", "2"), ("0.5", "1"))) == 2.0 and readers.spent(usage((None, "2"))) == 2.0 and readers.spent(usage(("x", None))) is None
    assert readers.gate(False, 0.0, 5.0) == "apify:disabled" and readers.gate(True, 6.0, 5.0) == readers.gate(True, None, 5.0) == "apify:budget" and readers.gate(True, 1.0, 5.0) is None
    a, b = (spark.createDataFrame(x, "k string, v long") for x in ([("x", 1), ("y", 1)], [("y", 2), ("y", 3)]))
    assert sorted(tuple(r) for r in readers.union_last_wins([a, b], ["k"]).collect()) == [("x", 1), ("y", 2), ("y", 3)]
    s = spark.createDataFrame([("a", True, "u"), ("b", False, "u"), ("c", True, ""), ("d", True, None)], "name string, enabled boolean, url string")
    assert [r["name"] for r in feed.enabled(s).collect()] == ["a"]


def test_crawl_rules(spark):
    p = spark.createDataFrame([("https://h.com/hub/", "The hub itself, long", None, "t"), ("https://h.com/a", None, "A title of enough length", "x" * 400), ("https://h.com/b", "short", None, None), (None, "No address but a title", None, "t"), ("https://h.com/c", None, None, "y" * 130)], "url string, meta_title string, title string, text string")
    got = {r["link"]: (r["title"], len(r["summary"])) for r in feed.crawled(p, "https://h.com/hub#top").collect()}
    assert got == {"https://h.com/a": ("A title of enough length", 300), "https://h.com/c": ("y" * 120, 130)}


def test_news(spark):
    n = spark.createDataFrame([(1, "Calm", "s", "l", "2", "news"), (2, "Why XLK rose", "s", "l", "9", "news"), (3, "Early", "s", "l", "1", "news"), (4, "XLK", "s", "l", "0", "insight")], "seq long, title string, source string, link string, published string, category string")
    m = spark.createDataFrame([("xlk",)], "asset string")
    assert [(r["title"], r["hot"]) for r in feed.hot_news(n, m, 2).collect()] == [("Why XLK rose", True), ("Early", False)]
    e = spark.createDataFrame([("Acme stock", k, f"t{k}", "l", "2024-01-01T00:00:00Z") for k in range(3)], "query string, seq long, title string, link string, published string")
    movers = spark.createDataFrame([(1, "ACM", "Acme", 0.1), (2, "ZZZ", None, -0.1)], "rank long, ticker string, name string, w1 double")
    assert [(r["ticker"], r["title"], r["published"]) for r in feed.ticker_news(e, movers).orderBy("title").collect()] == [("ACM", "t0", "2024-01-01T00:00"), ("ACM", "t1", "2024-01-01T00:00")]


def test_feed_spends_on_new_insights_only(spark):
    row = lambda i, c, page, title="T": (i, "s", c, f"http://a.com/{i}", f"{title} {i}", "", None, None, None, page)
    schema = "seq long, source string, category string, link string, title string, summary string, published string, media boolean, enclosure string, page string"
    e = spark.createDataFrame([row(1, "insight", "<svg/>"), row(2, "news", "<svg/>"), row(3, "insight", "<svg/>"), row(4, "insight", "<svg/>"), (5, "s", "insight", "", "No link", "", None, None, None, None), (6, "s", "insight", "http://a.com/6", "<b></b>", "", None, None, None, None)], schema)
    seen = feed.with_ids(e.where("seq = 1")).select("id")
    run = runs.feed_run(e, seen, budget=1)
    assert {r["seq"]: r["visual"] for r in run.tables["new"].collect()} == {2: "n/a", 3: "visual", 4: "text"}
    long = feed.with_ids(spark.createDataFrame([row(1, "news", None, "x" * 500)], schema)).first()
    assert len(long["title"]) == 241


def test_archive_merges_on_rerun(spark, tmp_path):
    root = str(tmp_path)
    a, b = (spark.createDataFrame(x, "id string, v string") for x in ([("1", "old"), ("2", "old")], [("2", "new"), ("3", "new")]))
    sinks.archive_day(a, root, "items", "2024-01-01")
    sinks.archive_day(b, root, "items", "2024-01-01")
    sinks.archive_day(b, root, "items", "2024-01-02")
    got = spark.read.parquet(f"{root}/items").where("day = '2024-01-01'").collect()
    assert {(r["id"], r["v"]) for r in got} == {("1", "old"), ("2", "new"), ("3", "new")}
    assert [str(r["day"]) for r in sinks.archive_dates(spark, root, "items").collect()] == ["2024-01-02", "2024-01-01"]
    assert sinks.archive_dates(spark, root, "none").count() == 0
    assert sinks.as_document(a.limit(1)).first()["value"] == '{"id":"1","v":"old"}'


def test_unreadable_artefact_is_an_error(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        sinks.load(spark, str(tmp_path), "bad", "id string").collect()


def test_batch_run_again_adds_nothing_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id string, v string")
    streams.append_unseen(frame("a", "a", "b"), 0, out)
    streams.append_unseen(frame("b", "c"), 1, out)
    streams.append_unseen(frame("b", "c"), 1, out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_references_are_decoded_once(spark):
    df = spark.createDataFrame([("&amp;lt; &eacute;&#233;&#xE9; &hellip; &#128512; &bogus; & &#xD800; AT&T &", None), (None, None)], "s string, t string")
    assert [r[0] for r in df.select(tx.unescape(F.col("s"))).collect()] == ["&lt; ééé … 😀 &bogus; & &#xD800; AT&T &", None]


def test_small_figures(spark):
    assert macro.implied_bps(3.5, 4.33) == -83.0 and macro.implied_bps(None, 1.0) is None
    w = spark.createDataFrame([("a", 0.5)], "family string, w double")
    assert registry.weight_of(w, "a") == 0.5 and registry.weight_of(w, "b") == 1.0
    assert registry.weight_of(registry.set_weight(registry.set_weight(w, "a", 2), "b", 3), "a") == 2.0
    m = spark.createDataFrame([(date(2024, k, 1),) for k in range(1, 9)], "d date")
    assert [r["d"].month for r in calendar.next_meetings(m, "2024-03-01").collect()] == [3, 4, 5, 6]
    e = spark.createDataFrame([("A", date(2024, 3, 1)), ("B", date(2024, 3, 8)), ("C", date(2024, 3, 9)), ("D", date(2024, 5, 1))], "asset string, d date")
    got = {r["asset"]: (r["recent"], r["w1"]) for r in calendar.earnings_window(e, spark.createDataFrame([("A", 0.1)], "asset string, w1 double"), "2024-03-05").collect()}
    assert got == {"A": (True, 0.1), "B": (False, None)}
    tiny = spark.createDataFrame([(5e-324, 5e-324, 1e-300, 1e-300)], "s double, k double, t double, v double")
    assert tiny.select(bs_gamma(F.col("s"), F.col("k"), F.col("t"), F.col("v"))).first()[0] == 0.0


def test_averages_on_every_row(spark):
    b = bars(spark, ramp("A", n=40)).withColumn("close", F.when(F.dayofmonth("d") == 9, None).otherwise(F.col("close")))
    rows = ts.ema_columns(b, (3,)).orderBy("d").collect()
    last = None
    for r in rows:
        if r["close"] is not None:
            last = r["close"] if last is None else r["close"] * 0.5 + last * 0.5
        assert r["e3"] == pytest.approx(last)
    whole = bars(spark, ramp("A"), ramp("B", slope=1.0))
    now = {r["asset"]: r for r in models.recursive(whole).collect()}
    history = models.exponential_history(whole)
    for r in history.join(history.groupBy("asset").agg(F.max("d").alias("d")), ["asset", "d"]).collect():
        assert all(r[k] == pytest.approx(now[r["asset"]][k]) for k in models.RECURSIVE)


def test_running_columns_are_the_windows_columns(spark):
    b = bars(spark, ramp("A"), ramp("B", slope=-0.2)).withColumn("close", F.col("close") + F.dayofmonth("d") % 3)
    names = ["sma_20", "sma_200", "rv_63", "rv_100", "lag_21", "lag_252"]
    fast = {(r["asset"], r["d"]): r for r in ts.running(b).select("asset", "d", *names).collect()}
    for r in ts.featured(b).select("asset", "d", *names).collect():
        for k in names:
            assert (fast[r["asset"], r["d"]][k] is None) == (r[k] is None) and (r[k] is None or fast[r["asset"], r["d"]][k] == pytest.approx(r[k], abs=1e-9))


def test_history_panel(spark):
    b = bars(spark, *[ramp(a, n=400, slope=0.3 + 0.1 * k) for k, a in enumerate("ABCDEF")])
    tags = spark.createDataFrame([(a, "style", f"l{k % 2}", "US") for k, a in enumerate("ABCDEF")], "asset string, grp string, label string, region string")
    rows = evaluation.signal_history(b, tags).collect()
    assert {r["family"] for r in rows} == {"frm_ts_mom", "frm_cs_region", "frm_composite"}
    days = sorted({r["date"] for r in rows})
    assert len(days) == len(range(253, 400, 21)) and len(rows) == len(days) * 6 * 3
    one = {r["family"]: r["signal"] for r in rows if r["date"] == days[-1] and r["asset"] == "F"}
    assert one["frm_cs_region"] == 1.0 and one["frm_ts_mom"] > 0
    hits = {r["grp"] for r in evaluation.hit_rate(b, tags.where("asset <> 'A'")).collect()}
    assert hits == {"all", "style", "other"}


def test_rate_shock_needs_the_rate(spark, sf):
    from tidemark.sources import adapters

    b, t = adapters.daily_bars(spark, sf), adapters.supplier_tags(spark, sf)
    # a series that ends at its height, and one that ends low
    rows = [("high", date(2024, 1, 1 + k), float(k)) for k in range(28)] + [("low", date(2024, 1, 1 + k), float(-k)) for k in range(28)]
    series = spark.createDataFrame(rows, "series_id string, d date, value double")
    for rate, active in (("low", False), ("high", True), ("none", False)):
        run = runs.signal_run(b, t, benchmark=1, today="2026-03-02", series=series, vix="low", credit="low", rate=rate)
        assert {r["id"]: r["active"] for r in run.tables["scenarios"].collect()}["rate_shock"] is active


def test_views(spark):
    s = spark.createDataFrame([("A", "relative_strength", "t", 0.9), ("A", "rs_short", "t", 0.1), ("B", "relative_strength", "t", -0.95), ("C", "relative_strength", "s", 0.2)], "asset string, family string, segment string, signal double")
    assert {r["asset"] for r in views.strongest(s, k=2).collect()} == {"A", "B"} and {r["family"] for r in views.strongest(s, k=1, keep=("relative_strength",)).collect()} == {"relative_strength"}
    assert [(r["segment"], r["signal"]) for r in views.by_segment(s).collect()] == [("s", 0.2), ("t", 0.9), ("t", 0.1), ("t", -0.95)]
    assert [r["asset"] for r in views.mean_strength(s, 1).collect()] == ["B"]
    e = spark.createDataFrame([("a", None, date(2024, 1, 2)), ("b", 5.0, date(2024, 1, 3)), ("c", 7.0, date(2024, 1, 1))], "ticker string, mktcap double, date date")
    assert [r["ticker"] for r in views.earnings_by(e).collect()] == ["c", "b", "a"] and [r["ticker"] for r in views.earnings_by(e, "date").collect()] == ["c", "a", "b"]
    g = spark.createDataFrame([(f"a{k:02d}", "x", float(k)) for k in range(31)] + [(f"b{k}", "y", float(k)) for k in range(3)], "asset string, grp string, v double")
    got = views.top_bottom_or_all(g, "v", "grp").collect()
    assert len(got) == 30 + 3 and "a15" not in {r["asset"] for r in got}
    assert views.pivot(s, "asset", "family", ["relative_strength", "rs_short"]).where("asset = 'A'").first()["rs_short"] == 0.1


def test_comparative_windows(spark):
    b = bars(spark, ramp("A", n=300), ramp("B", n=1))
    assert performance.comparative(b, 21, "2024-06-01").count() == 21
    ytd = performance.comparative(b, "YTD", "2025-06-01")
    assert ytd.count() > 20 and ytd.agg(F.min("d")).first()[0].year == 2025
    hourly = spark.createDataFrame([("A", datetime(2024, 1, 1, h), 10.0 + h) for h in range(5)], "asset string, d timestamp, close double")
    assert [round(r["pct"], 6) for r in performance.comparative(b, 5, "2024-06-01", hourly).orderBy("d").collect()] == [0.0, 10.0, 20.0, 30.0, 40.0]
    assert performance.daily_series(b).where("asset = 'A'").count() == 252


def test_checks(spark):
    o = spark.createDataFrame([("equity", "A", 1.0), ("bond", "B", None), ("fx", "C", 1.0)], "grp string, asset string, last double")
    s = spark.createDataFrame([(k, f"s{k}", None if k == 0 else float(-k)) for k in range(11)], "pos int, asset string, w1 double")
    m, e, n = spark.createDataFrame([("x",), (None,)], "name string"), spark.createDataFrame([(6e12,)], "mktcap double"), spark.createDataFrame([], "title string")
    got = {r["check"]: r["ok"] for r in quality.brief_checks(o, s, m, e, n, "2024-01-01", "2024-01-05").collect()}
    assert got == {"brief_fresh": True, "overview_groups": False, "overview_prices": False, "sector_count": True, "sectors_sorted": True, "movers_named": False, "plausible_market_caps": False, "ticker_news_present": False}


def test_means_by_integers(spark):
    df = spark.createDataFrame([("a", 0.1234), ("a", 0.1235), ("b", -0.1234), ("b", -0.1235), ("c", None)], "k string, x double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(ensemble.mean_to(F.col("x"), 4).alias("m")).collect()}
    assert got == {"a": 0.1235, "b": -0.1235, "c": None}
