import random
from datetime import date

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.options import bs_gamma
from tidemark.operators import calendar, feed, registry
from tidemark.plans import queries
from tidemark.sources import readers, sinks


def test_ids_ignore_query_and_case(spark):
    df = spark.createDataFrame([("https://Example.com/Post/?utm=1#frag", "a"), ("https://example.com/Post", "b"), ("", " Title "), (None, "title")], "u string, t string")
    ids = [r[0] for r in df.select(tx.item_id(F.col("u"), F.col("t"))).collect()]
    assert ids[0] == ids[1] and len(ids[0]) == 16 and ids[2] == ids[3] != ids[0]


def test_first_wins_and_seen(spark):
    i = spark.createDataFrame([(1, "x", "s"), (2, "x", "s"), (3, "y", "s")], "seq long, id string, source string")
    assert {(r["id"], r["seq"]) for r in feed.first_wins(i).collect()} == {("x", 1), ("y", 3)}
    assert [r["id"] for r in feed.unseen(i, spark.createDataFrame([("x",)], "id string")).collect()] == ["y"]


HUB = """<nav><a href="/menu/long-enough-anchor-text-here">A menu link of more than enough length</a></nav>
<main><a href="/insights/one">The first insight of the week in full</a><a href="/insights/two?x=1">Second insight: rates, growth and risk</a>
<a href="/about">About us and everything that we ever did</a><a href="https://other.example/insights/x">An insight on some other domain entirely</a>
<a href="/insights/pic.png">A picture that bears a long enough caption</a></main>"""


def test_links_of_hub():
    got = feed.links_of(HUB, "https://firm.example/hub", r"/insights/")
    assert [u for _, u in got] == ["https://firm.example/insights/one", "https://firm.example/insights/two?x=1"]
    same = '<a href="/research/alpha">Research note on alpha decay today</a><a href="/research/alpha/">Research note on alpha decay today</a><a href="/other">Something else that is long enough too</a>'
    assert len(feed.links_of(same, "https://firm.example/", "/research/")) == 1
    assert feed.links_of(None, "https://x.example") == []


def test_visual(spark):
    df = spark.createDataFrame([("<p>a<img src='x'></p>",), ("<p>plain text</p>",), (None,)], "h string")
    assert [r[0] for r in df.select(tx.has_visual(F.col("h"))).collect()] == [True, False, False]
    page = spark.createDataFrame([("<article><img src='logo.png'>words</article>",), ("<article><img src='c.png'></article>",), ("<article>see the chart below</article>",), ("<p>none</p>",)], "h string")
    assert [r[0] for r in page.select(tx.page_is_visual(F.col("h"))).collect()] == [False, True, True, False]


def test_classify_budget(spark):
    e = spark.createDataFrame([(1, None, None, "", "<svg/>"), (2, None, None, "", "<svg/>"), (3, True, None, "", None), (4, None, "image/png", "", None)], "seq long, media boolean, enclosure string, summary string, page string")
    kinds = {r["seq"]: r["kind"] for r in feed.classify(e, budget=1).collect()}
    assert kinds == {1: "visual", 2: "text", 3: "visual", 4: "visual"}


def test_numbers(spark):
    df = spark.createDataFrame([("$1,234,000,000",), ("N/A",), (None,)], "s string")
    assert [r[0] for r in df.select(tx.market_cap(F.col("s"))).collect()] == [1.234e9, None, None]
    g = spark.createDataFrame([(100.0, 100.0, 0.1, 0.2), (100.0, 150.0, 0.1, 0.2), (100.0, 100.0, 0.0, 0.2)], "s double, k double, t double, v double").select(bs_gamma(F.col("s"), F.col("k"), F.col("t"), F.col("v"))).collect()
    assert g[0][0] > g[1][0] and g[2][0] == 0.0


def test_calendar(spark):
    rows = calendar.events(spark, "2024-03-01").collect()
    by = {(r["event"], r["date"]) for r in rows}
    assert ("Triple witching", date(2024, 3, 15)) in by and ("Quarter-end", date(2024, 3, 29)) in by and ("Russell reconstitution", date(2024, 6, 28)) in by
    assert all(0 <= r["days_until"] <= 120 for r in rows)


def test_archive_and_defaults(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.load(spark, root, "none", "id string").count() == 0
    a = spark.createDataFrame([("1", "old"), ("2", "old")], "id string, v string")
    b = spark.createDataFrame([("2", "new"), ("3", "new")], "id string, v string")
    assert {tuple(r) for r in sinks.merged(a, b).collect()} == {("1", "old"), ("2", "new"), ("3", "new")}
    sinks.archive_day(a, root, "items", "2024-01-01")
    sinks.archive_day(b, root, "items", "2024-01-02")
    sinks.archive_day(b, root, "items", "2024-01-02")
    assert spark.read.parquet(f"{root}/items").count() == 4


def test_readers(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("DATE,X\n2024-01-01,1.5\n2024-01-02,.\n2024-01-03,\n2024-01-04,2\n")
    rows = readers.fred_csv(spark, str(p), "X", keep=1).collect()
    assert [(r["d"], r["value"]) for r in rows] == [(date(2024, 1, 4), 2.0)]
    assert readers.header_row(["note", None, "DATE", "x"]) == 2 and readers.header_row(["a"]) is None
    f = spark.createDataFrame([("m", ["4", "13F-HR", "13F-NT"], ["a", "b", "c"])], "manager string, forms array<string>, dates array<string>")
    assert readers.edgar_13f(f).first()["filed"] == "b"
    w = spark.createDataFrame([(date(2024, 1, 1), 1.0, 0.1)], "m date, `SMB` double, RF double")
    r = readers.french_factors(w, "US").collect()
    assert [(x["factor"], x["r"]) for x in r] == [("US:SMB", 0.01)]


def test_notes(spark):
    n = spark.createDataFrame([], registry.NOTE)
    from datetime import datetime

    n = registry.add_note(registry.add_note(n, (datetime(2024, 1, 1), "f", "a" * 300, "x", "s", "t")), (datetime(2024, 1, 2), "f", "b", "y", "s2", "t2"))
    rows = n.collect()
    assert rows[0]["source"] == "s2" and len(rows[1]["title"]) == 200


def test_percent_rounds_the_exact_double(spark):
    """As printf and Python do: ties in the double to the even digit, decimals that only look like ties by their exact value."""
    rnd = random.Random(3)
    x = [k * 5 / 10000 for k in range(-3000, 3000)] + [k / 800 for k in range(-300, 300)] + [rnd.uniform(-1, 1) * 10.0 ** rnd.randrange(-6, 15) for _ in range(3000)]
    x += [(2**52 + k / 2) / 1000 for k in range(200)] + [0.0, -0.0, -1e-9, 5e-324, 1e14, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(tx.percent(F.col("x"))).collect()]
    assert got == ["n/a" if v is None else f"{v:+.1%}" for v in x]


def test_market_cap_percent_of_odd_balances_same_as_sql(spark, tmp_path):
    balances = [9325.0, -9325.0, 25.0, 75.0, -25.0, 1245.0, 2415.0, 2895.0, 0.0, -0.0, -0.4, 1.005, 2.675, -0.125, 0.005, 1.115, 9999.995, 12345678901234.56, None]
    rows = [(k + 7 * i + 1, b) for i, b in enumerate(balances) for k in (0, 6)] + [(None, 25.0), (None, None)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = [tuple(r) for r in queries.QUERIES["market_cap_percent"](spark, str(tmp_path)).collect()]
    want = con.execute(queries.ORACLE_SQL["market_cap_percent"]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
