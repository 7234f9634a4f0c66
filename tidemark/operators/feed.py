"""Feed items: ids, deduplication against seen ids, merging, search, classification, links."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text, has_visual, item_id, page_is_visual


def with_ids(items: DataFrame, summary_limit: int = 320, title_limit: int = 240) -> DataFrame:
    """Entries with a link and a title as items: seq, id, source, category, title, link, summary, published.

    Without a column ``category`` all are insights.
    """
    optional = lambda c, x="": F.coalesce(F.col(c).cast("string"), F.lit("")) if c in items.columns else F.lit(x)
    rows = items.select("seq", "source", optional("category", "insight").alias("category"), clean_text(F.col("title"), title_limit).alias("title"), F.coalesce("link", F.lit("")).alias("link"), clean_text(F.col("summary"), summary_limit).alias("summary"), optional("published").alias("published"))
    return rows.where("link <> '' and title <> ''").select("seq", item_id(F.col("link"), F.col("title")).alias("id"), "source", "category", "title", "link", "summary", "published")


def enabled(sources: DataFrame) -> DataFrame:
    """Sources that are switched on and have an address."""
    return sources.where("enabled and coalesce(url, '') <> ''")


def in_category(items: DataFrame, category: str, sources: list[str] | None = None, visual: str | None = None) -> DataFrame:
    """Items of a category, of some sources and of one kind where these are given."""
    rows = items.where(F.col("category") == category)
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    return rows.where(F.col("visual") == visual) if visual else rows


def capped(items: DataFrame, k: int = 25) -> DataFrame:
    """The first ``k`` entries of each source, before anything is deduplicated."""
    return items.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy("seq"))).where(F.col("_k") <= k).drop("_k")


def first_wins(items: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row a key, the first by ``order``; partial aggregation before the exchange, no sort."""
    cols = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_x")).select(key, "_x.*")


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    return first_wins(items.join(seen.select("id"), "id", "left_anti"))


def search(items: DataFrame, text: str) -> DataFrame:
    q = text.lower()
    return items.where(F.lower("title").contains(q) | F.lower("source").contains(q))


def classify(entries: DataFrame, *, budget: int | None = 120, split: str | None = None, **words) -> DataFrame:
    """``kind``: visual or text. Media, an image enclosure or a drawing in the summary decide; else
    the page does, for as many entries as ``budget`` allows, in order of ``seq``.

    Only entries of the category ``split`` are told apart, where it is given; others are
    ``n/a`` and spend nothing. The entries whose page is read are a top-k of that size.
    """
    mine = F.coalesce(F.col("category") == split, F.lit(False)) if split else F.lit(True)
    hint = F.coalesce(F.col("media"), F.lit(False)) | F.coalesce(F.col("enclosure").contains("image"), F.lit(False)) | has_visual(F.col("summary"))
    e = entries.withColumn("_mine", mine).withColumn("_hint", hint)
    asked = e.where("_mine and not _hint and page is not null").select("seq")
    if budget is not None:
        asked = F.broadcast(asked.orderBy("seq").limit(budget))
    e = e.join(asked.distinct().withColumn("_read", F.lit(True)), "seq", "left")
    page = F.coalesce(F.col("_read"), F.lit(False)) & page_is_visual(F.col("page"), **words)
    return e.withColumn("kind", F.when(~F.col("_mine"), "n/a").when(F.col("_hint") | page, "visual").otherwise("text")).drop("_hint", "_mine", "_read")


def status(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source with the outcome of its last run."""
    return sources.join(runs, "source", "left").withColumn("state", F.when(F.col("ok").isNull(), "not run").when(F.col("ok"), "ok").otherwise("error"))


# Anchors that are never articles, and files that are no pages.
JUNK = re.compile(r"^(home|about|contact|subscribe|sign in|log ?in|menu|search|privacy|terms|cookie|careers|read more|learn more|next|prev|previous|all|more|share|tweet|back)\b", re.I)
ASSETS = re.compile(r"\.(png|jpe?g|gif|svg|css|js|ico|woff2?)(\?|$)", re.I)


class _Anchors(HTMLParser):
    """Anchors of each candidate region of a page, in page order."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.regions: dict[str, int] = {}
        self.found: list[tuple[str, list[str], frozenset[str]]] = []
        self.anchor: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        region = tag if tag in ("main", "article", "body") else "role" if a.get("role") == "main" else None
        if region in self.regions:
            region = None  # the first of its kind is the region
        elif region:
            self.regions[region] = 1
        if tag not in self.VOID:
            self.open.append((tag, region))
        if tag == "a" and a.get("href") is not None:
            self.anchor = []
            self.found.append((a["href"].strip(), self.anchor, frozenset(r for _, r in self.open if r)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if tag == "a":
            self.anchor = None

    def handle_data(self, data):
        if self.anchor is not None:
            self.anchor.append(data)


def links_of(html: str | None, base: str, pattern: str | None = None, most: int = 25, title_len: int = 25) -> list[tuple[str, str]]:
    """(title, url) of the article links in the main region of a page, on its own host."""
    if not html:
        return []
    page = _Anchors()
    page.feed(html)
    region = next((r for r in ("main", "article", "role", "body") if r in page.regions), None)
    host, wanted, seen, out = urlsplit(base).netloc.lower(), re.compile(pattern, re.I) if pattern else None, set(), []
    for href, parts, inside in page.found:
        if region and region not in inside or not href or href.startswith(("#", "mailto:", "javascript:", "tel:")):
            continue
        url = urljoin(base, href)
        u = urlsplit(url)
        title = " ".join(" ".join(p.strip() for p in parts).split())
        key = url.split("#")[0].rstrip("/")
        usable = u.scheme in ("http", "https") and u.netloc.lower() == host and not ASSETS.search(u.path) and (not wanted or wanted.search(u.path + ("?" + u.query if u.query else "")))
        if usable and len(title) >= title_len and not JUNK.match(title) and key not in seen:
            seen.add(key)
            out.append((title[:240], url))
            if len(out) == most:
                break
    return out


def extract_links(pages: DataFrame, *, url: str = "url", html: str = "html", pattern: str | None = None, most: int = 25, title_len: int = 25) -> DataFrame:
    """base, pos, title, link; parsing a page needs Python, batches go through Arrow."""

    def run(batches):
        for b in batches:
            rows = [(u, k, t, x) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if u for k, (t, x) in enumerate(links_of(h, u, pattern, most, title_len))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["base", "pos", "title", "link"])

    return pages.select(url, html).mapInArrow(run, "base string, pos long, title string, link string")


def news_hits(news: DataFrame, movers: DataFrame) -> DataFrame:
    """News with a flag whether its title or source names a mover; the movers are a short list."""
    names = movers.agg(F.collect_set(F.upper("asset")).alias("names"))
    j = news.crossJoin(F.broadcast(names))
    text = F.upper(F.concat_ws(" ", "title", "source"))
    return j.withColumn("hot", F.exists("names", lambda n: text.contains(n))).drop("names")


def hot_news(items: DataFrame, movers: DataFrame, limit: int = 8) -> DataFrame:
    """News items, those that name a mover first, then by date as published."""
    news = news_hits(items.where("category = 'news'"), movers)
    return news.orderBy(F.desc("hot"), "published", "seq").limit(limit).select("title", "source", "link", "hot")


def ticker_news(entries: DataFrame, movers: DataFrame, per: int = 2, most: int = 10) -> DataFrame:
    """ticker, name, move, title, link, published: the first headlines of the first movers that have any.

    ``entries`` (query, seq, title, link, published) are landed searches; ``movers``
    (rank, ticker, name, w1) ask for their name, or else their ticker, as a stock.
    """
    few = movers.orderBy("rank").limit(most).withColumn("query", F.concat(F.coalesce(F.nullif("name", F.lit("")), F.col("ticker")), F.lit(" stock")))
    first = F.row_number().over(Window.partitionBy("query").orderBy("seq"))
    found = entries.join(F.broadcast(few.select("query")).distinct(), "query", "left_semi").withColumn("_k", first).where(F.col("_k") <= per)
    return found.join(F.broadcast(few), "query").select("ticker", F.coalesce("name", F.lit("")).alias("name"), F.col("w1").alias("move"), "title", "link", F.left("published", F.lit(16)).alias("published"))


def crawled(pages: DataFrame, start: str, least: int = 12) -> DataFrame:
    """Pages that a crawl from ``start`` has found as entries: title, link, summary; without the start and the untitled."""
    link = F.trim(F.coalesce("url", F.lit("")))
    key = F.regexp_replace(F.regexp_replace(link, "#.*$", ""), "/+$", "")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    title = F.trim(F.coalesce(some("meta_title"), some("title"), F.left("text", F.lit(120)), F.lit("")))
    rows = pages.where((link != "") & (key != start.split("#")[0].rstrip("/"))).select(title.alias("title"), link.alias("link"), F.left(F.coalesce("text", F.lit("")), F.lit(300)).alias("summary"))
    return rows.where(F.length("title") >= least).withColumn("title", F.left("title", F.lit(240)))
