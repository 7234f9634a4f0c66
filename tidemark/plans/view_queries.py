"""Queries of views, feeds, files and checks over the driver's tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import ts
from tidemark.operators import ensemble, evaluation, feed, models, performance, quality, rotation, views
from tidemark.plans import sql as q
from tidemark.plans.queries import _CONSENSUS, _FRM, _HITS, _ITEMS, _REGIONS, _RS, _UNESC, _WALK, ORACLE_SQL, QUERIES, _signals, query, r6
from tidemark.sources import adapters, readers, sinks
from tidemark.sources.adapters import daily_bars, read, supplier_tags
from tidemark.sources.work import shared_dir

__all__ = ["ORACLE_SQL", "QUERIES"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


# --- sorts and picks -------------------------------------------------------------------

_EARN = "earn AS (SELECT c_name AS ticker, CASE WHEN c_acctbal > 0 THEN round(c_acctbal * 1e6) END AS mktcap, (DATE '2026-02-25' + CAST(c_custkey % 14 AS INTEGER))::DATE AS date FROM customer)"


def _earnings(spark, sf) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_name").alias("ticker"), F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 1e6)).alias("mktcap"), F.date_add(F.lit("2026-02-25").cast("date"), (F.col("c_custkey") % 14).cast("int")).alias("date"))


def _placed(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of a sorted table with their place."""
    few = rows.limit(k).select(F.collect_list(F.struct(*rows.columns)).alias("x"))
    return few.select(F.posexplode("x").alias("place", "r")).select("place", "r.*")


@query("earnings_by_market_cap", f"WITH {_EARN} SELECT CAST(row_number() OVER (ORDER BY mktcap DESC NULLS LAST, ticker) - 1 AS INTEGER) AS place, * FROM (SELECT * FROM earn ORDER BY mktcap DESC NULLS LAST, ticker LIMIT 40)")
def earnings_by_market_cap(spark, sf):
    return _placed(views.earnings_by(_earnings(spark, sf)), 40)


@query("earnings_by_date", f"WITH {_EARN} SELECT CAST(row_number() OVER (ORDER BY date, ticker) - 1 AS INTEGER) AS place, * FROM (SELECT * FROM earn ORDER BY date, ticker LIMIT 40)")
def earnings_by_date(spark, sf):
    return _placed(views.earnings_by(_earnings(spark, sf), "date"), 40)


@query("signals_by_segment", q.on_bars("SELECT CAST(row_number() OVER (ORDER BY segment, signal DESC, family) - 1 AS INTEGER) AS place, segment, family, signal FROM sig WHERE asset = 1", q.signals_cte()))
def signals_by_segment(spark, sf):
    one = _signals(spark, sf).where("asset = 1").select("segment", "family", "signal")
    return _placed(views.by_segment(one), 100)


_THEMES = ("relative_strength", "rs_short", "rs_long", "trend_vs_200dma")
_TH = f"th AS (SELECT l.asset, round({q.clip(f'0.6 * {_RS(63)} + 0.4 * {_RS(126)}')}, 4) AS relative_strength, round({q.clip(_RS(21))}, 4) AS rs_short, round({q.clip(_RS(126))}, 4) AS rs_long, round({q.clip('l.t200 * 6')}, 4) AS trend_vs_200dma FROM (SELECT * FROM g WHERE is_last) l, (SELECT n, g21, g63, g126 FROM g WHERE is_last AND asset = 1) b)"
_G = f"g AS (SELECT asset, d, n, is_last, {', '.join(f'close / nullif({q.lag(chr(99) + chr(108) + chr(111) + chr(115) + chr(101), k - 1)}, 0) AS g{k}' for k in (21, 63, 126))}, {q.ratio('close', q.sma('close', 200))} - 1 AS t200 FROM prep)"


def _themes(spark, sf) -> DataFrame:
    wide = rotation.relative_strength(daily_bars(spark, sf), 1)
    return wide.unpivot(["asset"], list(_THEMES), "family", "signal").withColumn("signal", F.round("signal", 4))


@query("strongest_themes", q.on_bars("SELECT asset, unnest(['relative_strength', 'rs_short', 'rs_long', 'trend_vs_200dma']) AS family, unnest([relative_strength, rs_short, rs_long, trend_vs_200dma]) AS signal FROM th WHERE asset IN (SELECT asset FROM th ORDER BY abs(relative_strength) DESC, asset LIMIT 25)", _G, _TH))
def strongest_themes(spark, sf):
    return views.strongest(_themes(spark, sf))


@query("theme_pivot", q.on_bars("SELECT * FROM th", _G, _TH))
def theme_pivot(spark, sf):
    return views.pivot(_themes(spark, sf), "asset", "family", list(_THEMES))


@query("mean_strength", q.on_bars("SELECT asset, sum(abs(t)) / (count(*) * 1e4) AS strength FROM (SELECT asset, CAST(round(signal * 10000) AS BIGINT) AS t FROM sig) GROUP BY asset ORDER BY sum(abs(t)) / (count(*) * 1e4) DESC, asset LIMIT 30".replace("(count(*) * 1e4) AS", "(count(*) * 1e4) AS"), q.signals_cte()))
def mean_strength(spark, sf):
    exact = _signals(spark, sf).groupBy("asset").agg((F.sum(F.abs(F.round(F.col("signal") * 10_000).cast("long"))) / (F.count(F.lit(1)) * 1e4)).alias("signal"))
    return views.mean_strength(exact)


@query("composite_top_bottom", q.on_bars("SELECT asset, grp, round(x, 6) AS composite FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY x DESC, asset) AS a, row_number() OVER (PARTITION BY grp ORDER BY x, asset) AS b FROM (SELECT asset, grp, " + q.clip("0.6 * mom + 0.3 * cs + 0.1 * pr") + " AS x FROM frm)) WHERE n <= 30 OR a <= 15 OR b <= 15", q.TAGS, _FRM))
def composite_top_bottom(spark, sf):
    f = rotation.factor_rotation(daily_bars(spark, sf), supplier_tags(spark, sf)).select("asset", "grp", F.col("frm_composite").alias("composite"))
    return views.top_bottom_or_all(f, "composite", "grp").withColumn("composite", r6("composite"))


@query("composite_pivot", q.on_bars("SELECT label, " + ", ".join(f"round(min(x) FILTER (region = '{r}'), 6) AS {r.lower().replace(' ', '_')}" for r in _REGIONS) + f" FROM (SELECT label, region, {q.clip('0.6 * mom + 0.3 * cs + 0.1 * pr')} AS x FROM frm) GROUP BY label", q.TAGS, _FRM))
def composite_pivot(spark, sf):
    f = rotation.factor_rotation(daily_bars(spark, sf), supplier_tags(spark, sf))
    p = views.pivot(f, "label", "region", _REGIONS, "frm_composite", F.min)
    return p.select("label", *[r6(F.col(f"`{r}`")).alias(r.lower().replace(" ", "_")) for r in _REGIONS])


_PICKS = "(SELECT asset FROM ((SELECT asset FROM c ORDER BY composite DESC, asset LIMIT 15) UNION (SELECT asset FROM c ORDER BY composite, asset LIMIT 15)))"


@query("segment_pivot", q.on_bars(f"SELECT s.asset, round(avg(signal) FILTER (segment = 'strategies'), 6) AS strategies, round(avg(signal) FILTER (segment = 'themes'), 6) AS themes FROM (SELECT asset, segment, signal FROM sig UNION ALL SELECT asset, 'themes', relative_strength FROM th) s JOIN {_PICKS} USING (asset) GROUP BY 1", q.signals_cte(), _CONSENSUS, _G, _TH))
def segment_pivot(spark, sf):
    s = _signals(spark, sf)
    picks = ensemble.top_and_bottom(ensemble.consensus(s, digits=10).select("asset", "composite"), "composite", 15)
    themes = _themes(spark, sf).where("family = 'relative_strength'").select("asset", F.lit("themes").alias("segment"), "signal")
    rows = s.select("asset", "segment", "signal").unionByName(themes).join(picks.select("asset"), "asset", "left_semi")
    return views.pivot(rows, "asset", "segment", ["strategies", "themes"]).select("asset", r6("strategies").alias("strategies"), r6("themes").alias("themes"))


@query("timeframe_pivot", q.on_bars("SELECT label, " + ", ".join(f"round(avg(signal) FILTER (timeframe = '{t}'), 6) + 0.0 AS f_{t}" for t in rotation.FRAMES) + f" FROM (SELECT timeframe, label, {q.peer('r', 'timeframe, grp, region')} AS signal FROM (" + " UNION ALL ".join(f"SELECT asset, '{t}' AS timeframe, CASE WHEN n >= {k + 2} THEN {q.change('close', k)} END AS r, n, is_last FROM prep" for t, k in rotation.FRAMES.items()) + ") x JOIN tags USING (asset) WHERE is_last AND n >= 60 AND r IS NOT NULL) GROUP BY label", q.TAGS))
def timeframe_pivot(spark, sf):
    rows = rotation.rotation_by_timeframe(daily_bars(spark, sf), supplier_tags(spark, sf))
    p = views.pivot(rows, "label", "timeframe", list(rotation.FRAMES))
    return p.select("label", *[(r6(F.col(f"`{t}`")) + 0.0).alias(f"f_{t}") for t in rotation.FRAMES])


# --- series ----------------------------------------------------------------------------


@query("daily_series", "WITH " + q.BARS + " SELECT asset, d, round(close + 1e-9, 4) AS c FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS k FROM bars WHERE close IS NOT NULL) WHERE k <= 252")
def daily_series(spark, sf):
    bars = daily_bars(spark, sf)
    return performance.daily_series(bars.withColumn("close", F.col("close") + 1e-9))


def _pct(rows: str) -> str:
    return f" SELECT asset, d, round((close / nullif(f, 0) - 1) * 100, 6) AS pct FROM (SELECT *, first_value(close) OVER (PARTITION BY asset ORDER BY d) AS f, count(*) OVER (PARTITION BY asset) AS n FROM {rows}) WHERE n >= 2 AND f > 0"


@query("rebase_ytd", "WITH " + q.BARS + _pct("(SELECT * FROM bars WHERE d >= DATE '2001-01-01')"))
def rebase_ytd(spark, sf):
    return performance.comparative(daily_bars(spark, sf), "YTD", "2001-06-30").withColumn("pct", r6("pct"))


@query("rebase_window", "WITH " + q.BARS + _pct("(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS k FROM bars) WHERE k <= 21)"))
def rebase_window(spark, sf):
    return performance.comparative(daily_bars(spark, sf), 21, "2001-06-30").withColumn("pct", r6("pct"))


@query("rebase_hourly", "WITH ticks AS (SELECT event_type AS asset, date_trunc('hour', ts) AS d, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2)" + _pct("ticks"))
def rebase_hourly(spark, sf):
    from tidemark.streaming import streams

    hourly = streams.bars(adapters.ticks(spark, sf)).select(F.col("key").alias("asset"), F.col("start").cast("timestamp_ntz").alias("d"), "close")
    return performance.comparative(daily_bars(spark, sf), 5, "2001-06-30", hourly).withColumn("pct", r6("pct"))


_RECUR = (
    "WITH RECURSIVE "
    + q.BARS
    + """, num AS (SELECT asset, d, close, row_number() OVER (PARTITION BY asset ORDER BY d) AS n FROM bars),
e AS (
  SELECT asset, n, d, close, close AS e12, close AS e20, close AS e26, 0.0::DOUBLE AS sig FROM num WHERE n = 1
  UNION ALL
  SELECT m.asset, m.n, m.d, m.close, m.close * (2.0 / 13) + e.e12 * (11.0 / 13), m.close * (2.0 / 21) + e.e20 * (19.0 / 21), m.close * (2.0 / 27) + e.e26 * (25.0 / 27),
    ((m.close * (2.0 / 13) + e.e12 * (11.0 / 13)) - (m.close * (2.0 / 27) + e.e26 * (25.0 / 27))) * 0.2 + e.sig * 0.8
  FROM e JOIN num m ON m.asset = e.asset AND m.n = e.n + 1
) """
)


@query("ema_columns", _RECUR + "SELECT asset, d, round(e12, 6) AS e12, round(e20, 6) AS e20, round(e26, 6) AS e26 FROM e")
def ema_columns(spark, sf):
    return ts.ema_columns(daily_bars(spark, sf)).select("asset", "d", *[r6(c).alias(c) for c in ("e12", "e20", "e26")])


@query("exponential_history", _RECUR + "SELECT asset, d, round((e12 / nullif(e26, 0) - 1) * 12, 6) AS ema_cross, round((e12 - e26 - sig) / (0.01 * close + 1e-9), 6) AS macd FROM e")
def exponential_history(spark, sf):
    return models.exponential_history(daily_bars(spark, sf)).select("asset", "d", r6("s151_ema_cross_12_26").alias("ema_cross"), r6("s151_macd").alias("macd"))


# --- feed ------------------------------------------------------------------------------

_CATEGORY = "CASE WHEN contains(url, '/en/') THEN 'insight' WHEN contains(url, '/fr/') THEN 'research' ELSE 'news' END"
_TITLE = _UNESC.replace("coalesce(html, '')", "coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '')")
_FULL = f"""raw AS (
  SELECT f.*, i.norm, i.id, i.source, trim(regexp_replace({_TITLE}, '[\\s ]+', ' ', 'g')) AS clean, {_CATEGORY} AS category FROM pages f JOIN items i ON f.page_id = i.seq
), entry AS (
  SELECT page_id AS seq, source, category, url AS link, id, CASE WHEN length(clean) > 240 THEN left(clean, 240) || '…' ELSE clean END AS title,
    regexp_matches(lower(html), '<(img|figure|table|svg|picture|canvas)[\\s/>]') AS drawn, row_number() OVER (PARTITION BY source ORDER BY page_id) AS k FROM raw
)"""


def _entries(spark, sf) -> DataFrame:
    rows = adapters.items(spark, sf)
    category = F.when(F.col("link").contains("/en/"), "insight").when(F.col("link").contains("/fr/"), "research").otherwise("news")
    none = F.lit(None)
    return rows.withColumns({"category": category, "published": F.col("seq").cast("string"), "media": none.cast("boolean"), "enclosure": none.cast("string"), "page": none.cast("string")})


@query("feed_new_items", f"WITH {_ITEMS}, {_FULL} SELECT id, min(seq) AS seq, first(source ORDER BY seq) AS source, first(category ORDER BY seq) AS category, first(CASE WHEN category <> 'insight' THEN 'n/a' WHEN drawn THEN 'visual' ELSE 'text' END ORDER BY seq) AS visual, first(title ORDER BY seq) AS title FROM entry WHERE k <= 25 AND link <> '' AND title <> '' GROUP BY id")
def feed_new_items(spark, sf):
    from tidemark.plans.runs import feed_run

    run = feed_run(_entries(spark, sf), spark.createDataFrame([], "id string"))
    return run.tables["new"].select("id", "seq", "source", "category", "visual", "title")


@query("category_split", f"WITH {_ITEMS}, {_FULL} SELECT seq, source FROM entry WHERE category = 'insight' AND NOT drawn AND contains(source, 'r') AND title <> ''")
def category_split(spark, sf):
    e = feed.with_ids(_entries(spark, sf)).join(read(spark, sf, "pages").select(F.col("page_id").alias("seq"), F.when(tx.has_visual(F.col("html")), "visual").otherwise("text").alias("visual")), "seq")
    return feed.in_category(e, "insight", visual="text").where(F.col("source").contains("r")).select("seq", "source")


_SOURCES = "src AS (SELECT s_name AS name, s_acctbal >= 0 AS enabled, CASE WHEN s_nationkey < 5 THEN '' WHEN s_nationkey < 8 THEN NULL ELSE 'https://feeds.example/' || s_suppkey END AS url FROM supplier)"


@query("enabled_sources", f"WITH {_SOURCES} SELECT name, url FROM src WHERE enabled AND url IS NOT NULL AND url <> ''")
def enabled_sources(spark, sf):
    n = F.col("s_nationkey")
    s = read(spark, sf, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("enabled"), F.when(n < 5, "").when(n >= 8, F.concat(F.lit("https://feeds.example/"), F.col("s_suppkey").cast("string"))).alias("url"))
    return feed.enabled(s).select("name", "url")


@query("hot_news", f"WITH {_ITEMS}, {_FULL}, hot AS (SELECT *, contains(upper(title || ' ' || source), 'DE') OR contains(upper(title || ' ' || source), 'LA') AS hot FROM entry WHERE category = 'news' AND title <> '') SELECT title, source, link, hot FROM hot ORDER BY hot DESC, CAST(seq AS VARCHAR), seq LIMIT 8")
def hot_news(spark, sf):
    movers = spark.createDataFrame([("De",), ("la",)], "asset string")
    return feed.hot_news(feed.with_ids(_entries(spark, sf)), movers)


@query("ticker_news", "WITH m AS (SELECT s_name AS ticker, CASE WHEN s_suppkey < 4 THEN s_name ELSE '' END AS name, s_acctbal AS w1, s_suppkey AS rank FROM supplier ORDER BY s_suppkey LIMIT 10), e AS (SELECT s_name || ' stock' AS query, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS seq, l_shipmode_ AS title FROM (SELECT *, CAST(l_shipdate AS VARCHAR) AS l_shipmode_ FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey) SELECT ticker, name, w1 AS move, e.title, CAST(e.seq AS VARCHAR) AS link, left(e.title, 16) AS published FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY seq) AS k FROM e) e JOIN m ON e.query = coalesce(nullif(m.name, ''), m.ticker) || ' stock' WHERE k <= 2")
def ticker_news(spark, sf):
    s, li = read(spark, sf, "supplier"), read(spark, sf, "lineitem")
    movers = s.select(F.col("s_suppkey").alias("rank"), F.col("s_name").alias("ticker"), F.when(F.col("s_suppkey") < 4, F.col("s_name")).otherwise("").alias("name"), F.col("s_acctbal").alias("w1"))
    when = F.date_format(F.col("l_shipdate"), "yyyy-MM-dd HH:mm:ss")
    landed = li.join(s, li.l_suppkey == s.s_suppkey).select(F.concat("s_name", F.lit(" stock")).alias("query"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("seq"), when.alias("title"), when.alias("published"))
    return feed.ticker_news(landed.withColumn("link", F.col("seq").cast("string")), movers)


@query("crawled_entries", "WITH x AS (SELECT trim(url) AS link, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '') AS key, left(trim(coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), left(html, 120))), 240) AS title, left(html, 300) AS summary FROM pages) SELECT title, link, summary FROM x WHERE link <> '' AND key <> 'https://none.example' AND length(title) >= 12")
def crawled_entries(spark, sf):
    p = read(spark, sf, "pages").select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("meta_title"), F.lit(None).cast("string").alias("title"), F.col("html").alias("text"))
    return feed.crawled(p, "https://none.example/#top")


_BODY = "coalesce(nullif(regexp_extract(html, '(?is)<article[\\s>](.*?)</article>', 1), ''), nullif(regexp_extract(html, '(?is)<main[\\s>](.*?)</main>', 1), ''), html)"
_PLAIN = "regexp_replace(body, '<[^>]+>', ' ', 'g')"
for _a, _b in tx.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"
QUERIES.pop("page_classify"), QUERIES.pop("extract_links")


@query("page_classify", f"WITH b AS (SELECT page_id, {_BODY} AS body FROM pages) SELECT page_id, len(list_filter(regexp_extract_all(body, '(?is)(<img[\\s/][^>]*>|<img>)', 1), lambda i: NOT regexp_matches(lower(i), 'logo|icon|avatar|sprite'))) > 0 OR regexp_matches(lower(body), '<(figure|table|svg)[\\s/>]') OR regexp_matches(left(trim(regexp_replace({_PLAIN}, '[\\s ]+', ' ', 'g')), 4000), '(?i)(^|[^a-z0-9_])(quelle|haut)([^a-z0-9_]|$)') AS visual FROM b")
def page_classify(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.page_is_visual(F.col("html"), chart_words=("quelle", "haut")).alias("visual"))


@query("extract_links", r"""WITH a AS (
  SELECT page_id, url AS base, regexp_extract(url, '^[a-z]+://[^/]+') AS site, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS nth FROM pages
), u AS (
  SELECT page_id, base, nth, trim(regexp_replace(label, '\s+', ' ', 'g')) AS title, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS link FROM a WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|javascript:|tel:)')
), k AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, rtrim(split_part(link, '#', 1), '/') ORDER BY nth) AS r FROM u
  WHERE starts_with(lower(link), lower(regexp_extract(base, '^[a-z]+://[^/]+'))) AND length(title) >= 3 AND NOT regexp_matches(title, '(?i)^(home|about|contact|subscribe|sign in|log ?in|menu|search|privacy|terms|cookie|careers|read more|learn more|next|prev|previous|all|more|share|tweet|back)\b') AND NOT regexp_matches(link, '(?i)\.(png|jpe?g|gif|svg|css|js|ico|woff2?)(\?|$)')
) SELECT base, row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1 AS pos, title, link FROM k WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY nth) <= 25""")
def extract_links(spark, sf):
    return feed.extract_links(read(spark, sf, "pages").withColumn("html", F.regexp_replace("html", "</?article>", "")), title_len=3)


# --- files -----------------------------------------------------------------------------


@query("archive_rerun", f"WITH {_ITEMS}, old AS (SELECT id, min(seq) AS seq FROM items GROUP BY 1), new AS (SELECT id, min(seq) + 1000000 AS seq FROM items WHERE contains(source, '.net') GROUP BY 1), day AS (SELECT DATE '2026-03-02' AS day, id, coalesce(n.seq, o.seq) AS seq FROM old o FULL JOIN new n USING (id)) SELECT * FROM day UNION ALL SELECT DATE '2026-03-03', id, seq FROM new")
def archive_rerun(spark, sf):
    """A day written, run again with other items, and another day; then all days."""
    root, i = _folder(spark, "archive"), adapters.items(spark, sf)
    i = i.select(tx.item_id(F.col("link"), F.col("title")).alias("id"), "source", "seq")
    old = i.groupBy("id").agg(F.min("seq").alias("seq"))
    new = i.where(F.col("source").contains(".net")).groupBy("id").agg((F.min("seq") + 1000000).alias("seq"))
    for rows, day in ((old, "2026-03-02"), (new, "2026-03-02"), (new, "2026-03-03")):
        sinks.archive_day(rows, root, "items", day)
    return sinks.load(spark, root, "items", "id string, seq long, day date").select("day", "id", "seq")


@query("archive_dates", "SELECT CAST(row_number() OVER (ORDER BY day DESC) - 1 AS INTEGER) AS place, day FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)")
def archive_dates(spark, sf):
    root = _folder(spark, "dates")
    read(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), "event_id").write.partitionBy("day").parquet(f"{root}/events")
    return _placed(sinks.archive_dates(spark, root, "events"), 100_000)


@query("csv_series", f"WITH {q.MACRO} SELECT series_id, d, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC) AS k FROM macro WHERE series_id = 'click') WHERE k <= 20")
def csv_series(spark, sf):
    """A series written as CSV and read back."""
    root = _folder(spark, "csv")
    adapters.macro(spark, sf).where("series_id = 'click'").select(F.col("d").alias("DATE"), F.col("value").alias("CLICK")).write.option("header", True).csv(root)
    return readers.fred_csv(spark, root, "click", keep=20).withColumn("value", r6("value"))


@query("screener_csv", "SELECT c_name AS ticker, round(c_acctbal, 2) AS change_pct FROM customer")
def screener_csv(spark, sf):
    root = _folder(spark, "screener")
    read(spark, sf, "customer").select(F.col("c_name").alias("Ticker"), F.col("c_acctbal").alias("Change %")).write.option("header", True).csv(root)
    return readers.screener_csv(spark, root).select("ticker", F.round(F.col("change_pct").cast("double"), 2).alias("change_pct"))


@query("price_scan", "WITH " + q.BARS + ", young AS (SELECT asset FROM bars WHERE asset BETWEEN 1 AND 20 GROUP BY 1), more AS (SELECT asset FROM bars WHERE asset > 20 AND asset <= 60 GROUP BY 1 HAVING count(*) >= 60) SELECT asset, count(*) AS n, 'held' AS state FROM bars WHERE asset IN (SELECT asset FROM young UNION SELECT asset FROM more) GROUP BY 1 UNION ALL SELECT asset, 0, 'missing' FROM (SELECT unnest(generate_series(1, 60)) AS asset) WHERE asset NOT IN (SELECT asset FROM young UNION SELECT asset FROM more)")
def price_scan(spark, sf):
    """Twenty assets in a young cache, sixty wanted, the others landed."""
    root, bars = _folder(spark, "prices"), daily_bars(spark, sf)
    sinks.save(bars.where("asset <= 20"), root, "prices")
    wanted = spark.range(1, 61).withColumnRenamed("id", "asset")
    held, missing = readers.prices(spark, root, "prices", wanted, landed=bars)
    return held.groupBy("asset").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("held")).unionByName(missing.select("asset", F.lit(0).cast("long").alias("n"), F.lit("missing").alias("state")))


@query("usage_by_way", "SELECT event_type AS via, count(*) AS calls, round(sum(value), 4) AS usd FROM events GROUP BY 1")
def usage_by_way(spark, sf):
    return sinks.usage(read(spark, sf, "events").select(F.col("event_type").alias("via"), F.col("value").alias("usd"))).withColumn("usd", F.round("usd", 4))


@query("robots_gate", "SELECT page_id FROM pages WHERE NOT contains(lower(regexp_extract(url, '//([^/:]+)', 1)), 'r')")
def robots_gate(spark, sf):
    p = read(spark, sf, "pages").select("page_id", "url")
    rules = p.select(F.lower(F.regexp_extract("url", "//([^/:]+)", 1)).alias("host")).where(F.col("host").contains("r")).distinct().withColumn("allowed", F.lit(False))
    return readers.allowed(p, rules).select("page_id")


# --- checks ----------------------------------------------------------------------------


@query("brief_checks", q.on_bars("""SELECT unnest(['brief_fresh', 'overview_groups', 'overview_prices', 'sector_count', 'sectors_sorted', 'plausible_market_caps', 'ticker_news_present']) AS "check",
  unnest([true, (SELECT count(DISTINCT n_regionkey) FILTER (n_regionkey < 4) = 4 FROM nation), (SELECT count(*) FILTER (close IS NULL) = 0 FROM prep WHERE is_last), (SELECT count(*) = 11 FROM nation), true, (SELECT count(*) FILTER (c_acctbal * 1e6 > 5e9) = 0 FROM customer), (SELECT count(*) > 0 FROM pages)]) AS ok"""))
def brief_checks(spark, sf):
    n = read(spark, sf, "nation")
    group = F.element_at(F.array(*map(F.lit, ("equity", "commodity", "bond", "fx", "other"))), F.col("n_regionkey") + 1)
    last = ts.featured_last(daily_bars(spark, sf)).select("asset", F.col("close").alias("last"))
    overview = last.unionByName(n.select(F.col("n_nationkey").cast("long").alias("asset"), F.lit(1.0).alias("last"))).withColumn("grp", F.lit(None).cast("string")).unionByName(n.select(F.col("n_nationkey").cast("long").alias("asset"), F.lit(1.0).alias("last"), group.alias("grp")))
    sectors = n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("asset"), (-F.col("n_nationkey")).cast("double").alias("w1"))
    earnings = _earnings(spark, sf).withColumn("mktcap", F.col("mktcap"))
    checked = quality.brief_checks(overview, sectors, n.select(F.col("n_name").alias("name")), earnings, read(spark, sf, "pages"), "2026-03-01", "2026-03-02", most_cap=5e9)
    return checked.where(F.col("check") != "movers_named").select("check", "ok")


@query("run_checks", q.on_bars("""SELECT unnest(['status_present', 'run_fresh', 'enough_signals', 'high_confidence_reached', 'enough_rotation_signals', 'no_duplicate_assets', 'universe_groups', 'labels_resolve', 'price_panel_present', 'rotation_frames', 'hit_rates_present']) AS "check",
  unnest([count(*) > 0, DATE '2001-12-31' - max("asof") <= 10, count(*) > 1000, count(*) FILTER (confidence = 'high') > 0, count(*) FILTER (segment = 'factor_rotation') > 500, true, false, true, true, true, (SELECT count(*) > 0 FROM hits WHERE abs(s) >= 0.05 AND f IS NOT NULL AND f <> 0)]) AS ok FROM sig""", q.signals_cte(), _WALK, _HITS))
def run_checks(spark, sf):
    bars, tags, s = daily_bars(spark, sf), supplier_tags(spark, sf), _signals(spark, sf)
    panel = performance.price_panel(bars).withColumn("asset", F.col("asset").cast("string"))
    universe = tags.withColumn("asset", F.col("asset").cast("string"))
    checked = quality.run_checks(s.select(F.col("asof").alias("d")), s, universe, panel, rotation.rotation_by_timeframe(bars, tags), evaluation.hit_rate(bars, tags), "2001-12-31", benchmark="1", named=("1", "2"))
    return checked.select("check", "ok")
