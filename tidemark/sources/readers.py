"""Readers of the public formats that signals come from, and landed feeds.

Each one turns a file into a typed DataFrame; fetching it is the caller's.
"""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import first_number
from tidemark.sources.sinks import cached

PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]


def price_panel(bars: DataFrame, least: int = 60) -> DataFrame:
    """Without rows that are all missing and assets of under ``least`` rows; NaN becomes null."""
    rows = bars.select("asset", "d", *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in PRICE_COLUMNS]).na.drop("all", subset=PRICE_COLUMNS)
    long = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    return rows.join(long, "asset", "left_semi")


def prices(spark: SparkSession, root: str, name: str, wanted: DataFrame, *, landed: DataFrame | None = None, max_age_hours: float = 18.0, least: int = 60) -> tuple[DataFrame | None, DataFrame]:
    """(bars of the wanted assets, wanted assets without any): from a young cache, else from ``landed``.

    Where the cache lacks some, ``landed`` (fetched by the caller) adds these.
    """
    held = cached(spark, root, name, max_age_hours)
    held = None if held is None else held.join(wanted.select("asset"), "asset", "left_semi")
    if landed is not None:
        more = price_panel(landed.join(wanted.select("asset"), "asset", "left_semi"), least)
        more = more if held is None else more.join(held.select("asset").distinct(), "asset", "left_anti")
        held = more if held is None else held.select(*more.columns).unionByName(more)
    missing = wanted.select("asset") if held is None else wanted.select("asset").join(held.select("asset").distinct(), "asset", "left_anti")
    return held, missing


def fred_csv(spark: SparkSession, path: str, series_id: str, keep: int = 520) -> DataFrame:
    """series_id, d, value: the last ``keep`` readable values."""
    raw = spark.read.option("header", True).csv(path)
    day, value = raw.columns[:2]
    rows = raw.select(F.lit(series_id).alias("series_id"), F.col(f"`{day}`").try_cast("date").alias("d"), F.col(f"`{value}`").try_cast("double").alias("value")).where("value is not null and d is not null")
    return last_rows(rows, ["series_id"], "d", keep)


def last_rows(df: DataFrame, by: list[str], order: str, keep: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).where(F.col("_k") <= keep).drop("_k")


def cot_json(spark: SparkSession, path: str, markets: list[str], weeks: int = 104) -> DataFrame:
    """Positions of the markets whose name a report's name contains, the latest ``weeks`` rows each.

    The market list is a small parameter, so the containment join is broadcast.
    """
    raw = spark.read.json(path)
    has = lambda *names: first_number(*[F.col(n).cast("string") for n in names if n in raw.columns]) if any(n in raw.columns for n in names) else F.lit(0.0)
    name = F.upper("market_and_exchange_names")
    rows = raw.select(
        name.alias("name"), F.to_date(F.left("report_date_as_yyyy_mm_dd", F.lit(10))).alias("d"),
        (has("dealer_positions_long_all") - has("dealer_positions_short_all")).alias("dealer_net"), (has("asset_mgr_positions_long", "asset_mgr_positions_long_all") - has("asset_mgr_positions_short", "asset_mgr_positions_short_all")).alias("asset_mgr_net"),
        (has("lev_money_positions_long", "lev_money_positions_long_all") - has("lev_money_positions_short", "lev_money_positions_short_all")).alias("lev_money_net"), (has("m_money_positions_long_all") - has("m_money_positions_short_all")).alias("mgd_money_net"),
        has("open_interest_all").alias("open_interest"),
    )
    wanted = spark.createDataFrame([(m,) for m in markets], "market string")
    return last_rows(rows.join(F.broadcast(wanted), rows.name.contains(F.upper("market"))).drop("name"), ["market"], "d", weeks)


def edgar_13f(filings: DataFrame) -> DataFrame:
    """First filing of each manager whose form begins with 13F; ``forms`` and ``dates`` are parallel arrays."""
    rows = filings.select("manager", F.posexplode(F.arrays_zip("forms", "dates")).alias("pos", "f")).where(F.col("f.forms").startswith("13F"))
    return rows.groupBy("manager").agg(F.min_by(F.col("f.forms"), "pos").alias("form"), F.min_by(F.col("f.dates"), "pos").alias("filed"))


def screener_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header in lower case, blanks to underscores, % to pct."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*[c.strip().lower().replace(" ", "_").replace("%", "pct") for c in raw.columns])


def french_factors(wide: DataFrame, region: str) -> DataFrame:
    """Monthly percentages by factor column -> factor 'REGION:FACTOR', region, m, r as a fraction; no risk-free rate."""
    value = [c for c in wide.columns if c not in ("m", "RF")]
    long = wide.unpivot("m", [F.col(c).cast("double").alias(c) for c in value], "name", "pct")
    return long.where("pct is not null and pct > -99").select(F.concat(F.lit(f"{region}:"), F.trim("name")).alias("factor"), F.lit(region).alias("region"), F.trunc("m", "month").alias("m"), (F.col("pct") / 100).alias("r"))


def header_row(cells: list) -> int | None:
    """Index of the first row that is headed by 'date'."""
    return next((i for i, c in enumerate(cells) if isinstance(c, str) and c.strip().lower() == "date"), None)


def sheet_cells(spark: SparkSession, path: str, sheet: str) -> list[list[str | None]]:
    """Rows of cells of a sheet of a workbook, as text; one file is one workbook, so it fits the driver."""
    data = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    book = zipfile.ZipFile(io.BytesIO(bytes(data)))
    tree = lambda name: ElementTree.fromstring(book.read(name))
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in tree("xl/sharedStrings.xml")]
    names = [e.attrib["name"] for e in tree("xl/workbook.xml").iter() if local(e) == "sheet"]
    if sheet not in names:
        return []
    rows: list[list[str | None]] = []
    for row in (e for e in tree(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml").iter() if local(e) == "row"):
        cells: list[str | None] = []
        for c in (e for e in row if local(e) == "c"):
            at = 0
            for letter in c.attrib.get("r", "").rstrip("0123456789"):
                at = at * 26 + ord(letter) - 64
            cells += [None] * (max(at - 1, len(cells)) - len(cells))
            text = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
            cells.append(shared[int(text)] if c.attrib.get("t") == "s" and text else text or None)
        rows.append(cells)
    return rows


def factor_sheet(spark: SparkSession, rows: list[list], regions: dict[str, str] | None = None, label: str = "", least: int = 24) -> DataFrame:
    """Cells of a sheet -> factor, region, m, r of the series of over ``least`` values below the row headed by 'date'.

    ``regions`` maps the columns that count to regions, the factor then is
    'REGION:label'; without it every column is a factor. Dates are ISO, month/day/year
    or a sheet's day numbers.
    """
    at = header_row([r[0] if r else None for r in rows[:40]])
    names = [str(n).strip() if n is not None else "" for n in rows[at]] if at is not None else []
    wanted = {k: (f"{regions[n]}:{label}", regions[n]) if regions else (n, n[:2]) for k, n in enumerate(names) if k and n and (not regions or n in regions)}
    cells = [(*wanted[k], str(r[0]), str(r[k])) for r in (rows[at + 1 :] if at is not None else []) for k in wanted if k < len(r) and r[0] is not None and r[k] is not None]
    day = F.coalesce(F.try_to_timestamp("m", F.lit("M/d/yyyy")).cast("date"), F.when(F.col("m").rlike(r"^[0-9]+([.]0*)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.col("m").try_cast("double").cast("int"))), F.col("m").try_cast("date"))
    long = spark.createDataFrame(cells, "factor string, region string, m string, r string").select("factor", "region", F.trunc(day, "month").alias("m"), F.col("r").try_cast("double").alias("r")).where("m is not null and r is not null")
    return long.join(long.groupBy("factor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > least), "factor", "left_semi")


def union_last_wins(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all frames; of those with equal keys, those of the last frame that has them."""
    tagged = [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    last = F.max("_from").over(Window.partitionBy(*keys))
    return out.withColumn("_last", last).where("_from = _last").drop("_from", "_last")


class _Table(HTMLParser):
    """Rows of cells of the first table of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.state, self.cell = "before", None

    def handle_starttag(self, tag, attrs):
        if tag == "table" and self.state == "before":
            self.state = "inside"
        elif self.state == "inside" and tag == "tr":
            self.rows.append([])
        elif self.state == "inside" and tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.cell = True
        elif tag == "sup":
            self.cell = None

    def handle_endtag(self, tag):
        if tag == "table" and self.state == "inside":
            self.state = "after"
        elif tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.state == "inside" and self.cell:
            self.rows[-1][-1] += data


def first_table(spark: SparkSession, html: str) -> DataFrame:
    """The first table of one page, columns named by its head in lower case."""
    page = _Table()
    page.feed(html)
    head, *body = page.rows or [[]]
    names = [" ".join(n.split()).lower() for n in head]
    rows = [tuple(" ".join(c.split()) for c in r) for r in body if len(r) == len(names)]
    return spark.createDataFrame(rows, ", ".join(f"`{n or k}` string" for k, n in enumerate(names)) or "none string")


def constituents(table: DataFrame, symbol: str = "symbol", name: str = "security") -> DataFrame:
    """symbol with '.' as '-', name; of repeated symbols one."""
    rows = table.select(F.trim(F.translate(F.col(f"`{symbol}`"), ".", "-")).alias("symbol"), F.trim(F.col(f"`{name}`")).alias("name"))
    return rows.groupBy("symbol").agg(F.min("name").alias("name"))


def landed_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS 2.0 items and Atom entries of feed files: title, link, summary, published."""
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names], F.lit(""))
    rss = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string, updated string, created string").load(path)
    atom = spark.read.format("xml").option("rowTag", "entry").option("valueTag", "_text").schema("title string, link array<struct<_href:string,_rel:string>>, summary string, content string, published string, updated string, created string").load(path)
    # the alternate link, which may leave its relation out
    href = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")[0]["_href"]
    entries = atom.withColumn("href", href).select(first("title").alias("title"), first("href").alias("link"), first("summary", "content").alias("summary"), first("published", "updated", "created").alias("published"))
    return rss.select(first("title").alias("title"), first("link").alias("link"), first("description").alias("summary"), first("pubDate", "updated", "created").alias("published")).unionByName(entries)


def first_way(fetched: DataFrame, order: tuple[str, ...] = ("direct", "render", "crawl")) -> DataFrame:
    """url, html, via: the first way that returned a page, by ``order``."""
    ok = fetched.where("html is not null and html <> ''").join(F.broadcast(fetched.sparkSession.createDataFrame([(w, i) for i, w in enumerate(order)], "via string, o int")), "via")
    return ok.groupBy("url").agg(F.min_by("html", "o").alias("html"), F.min_by("via", "o").alias("via"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` that their host's rules (host, allowed) don't forbid; hosts without rules are open."""
    host = F.lower(F.regexp_extract("url", "//([^/:]+)", 1))
    return urls.withColumn("host", host).join(rules.select("host", "allowed"), "host", "left").where(F.coalesce("allowed", F.lit(True))).drop("allowed", "host")


def spent(usage: DataFrame) -> float | None:
    """US dollars of the month: the discounted sum, else the plain one; None where neither can be read."""
    number = lambda c: F.sum(F.col(c).try_cast("double"))
    row = usage.agg(F.coalesce(F.nullif(number("discounted"), F.lit(0.0)), number("plain")).alias("usd")).first()
    return None if row is None else row["usd"]


def within_budget(spent_: float | None, limit: float) -> bool:
    """Unreadable spending counts as exhausted."""
    return spent_ is not None and spent_ < limit


def gate(enabled: bool, spent_: float | None, limit: float) -> str | None:
    """Why a paid crawl must not run, or None."""
    return "apify:disabled" if not enabled else None if within_budget(spent_, limit) else "apify:budget"
