"""Resolution of WARC not-modified revisits.

A revisit record stands for a 304 answer: its body is that of an earlier full
response. Each one is joined as-of, by canonical URL, to the latest earlier full
response; its validators are checked against that response's, and the headers
that a 304 may update are merged over the stored ones.

Defined cases: a null URL matches nothing (``no_earlier``); of responses at the
same time the one with the larger record id counts; a response at the revisit's
own time isn't earlier; null times match nothing; null header maps are empty, null
values too; header names that differ in case only are one;
repeated revisits are each resolved; an empty table gives no rows. DataFrame
functions only. A URL with any share of the records is split into time slices:
each slice is sorted by itself, and one summary row a slice carries the latest
response on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Fields that describe the stored body or one connection, which a 304 doesn't update.
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, trailing slash and tracking parameters; host in lower case."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(query, "(^|&)(utm_[a-z]*|ref)=[^&]*", ""), "^&", "")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with those of the 304 over them that it may update.

    Names are in lower case; values of names that differ in case only are one list,
    joined by ``, `` in the order of their original names.
    """
    empty = F.create_map().cast("map<string,string>")

    def lower(m: Column) -> Column:
        entries = F.array_sort(F.map_entries(F.coalesce(m, empty)))
        names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
        value = lambda n: F.array_join(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), ", ")
        return F.map_from_arrays(names, F.transform(names, value))

    new = F.map_filter(lower(update), lambda k, _: ~k.isin(NOT_MERGED))
    old = F.map_filter(lower(stored), lambda k, _: ~F.map_contains_key(new, k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(old), F.map_entries(new))))


def resolve_revisits(records: DataFrame, *, slices: int = 128) -> DataFrame:
    """``records``: record_id, url, ts, kind ('response' or 'revisit'), etag, last_modified, headers map.

    One row for each revisit: record_id, canonical_url, target_id, status
    (``resolved``, ``mismatch``, ``unverified`` without a validator,
    ``no_earlier``) and the merged headers (null unless resolved).
    """
    full = F.col("kind") == "response"
    body = F.struct("record_id", "etag", "last_modified", "headers")
    rows = records.where(F.col("kind").isin("response", "revisit")).select(canonical_url(F.col("url")).alias("key"), "ts", F.when(full, 1).otherwise(0).alias("is_full"), "record_id", "etag", "last_modified", "headers")
    rows = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    bounds = rows.agg(F.percentile_approx("us", [i / slices for i in range(1, slices)], 10_000).alias("b")).first()["b"] or []
    cuts = sorted(set(bounds))
    slice_ = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= F.col("us"))) if cuts else F.lit(0)
    # a null key or time matches nothing, but its revisits are still reported: they keep partitions of their own
    lone = F.col("key").isNull() | F.col("us").isNull()
    rows = rows.withColumn("slice", F.when(lone, F.pmod(F.xxhash64("record_id"), F.lit(1024)).cast("int") + 1_000_000).otherwise(slice_)).withColumn("lone", lone)
    response = F.when((F.col("is_full") == 1) & ~F.col("lone"), F.struct(F.col("us").alias("at"), body.alias("body")))
    inside = Window.partitionBy("key", "slice").orderBy("us", "is_full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.where((F.col("is_full") == 1) & ~F.col("lone")).groupBy("key", "slice").agg(F.max_by(F.struct(F.col("us").alias("at"), body.alias("body")), F.struct("us", "record_id")).alias("last"))
    seen = rows.where(~F.col("lone")).select("key", "slice").distinct()
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.join(last, ["key", "slice"], "left").withColumn("carried", F.last("last", ignorenulls=True).over(before)).select("key", "slice", "carried").where("carried is not null")
    found = rows.withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("is_full = 0").join(carried, ["key", "slice"], "left")
    target = F.when(~F.col("lone"), F.coalesce("near", "carried"))["body"]
    found = found.withColumn("target", target)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    status = (
        F.when(F.col("target").isNull(), "no_earlier")
        .when(F.col("etag").isNotNull(), F.when(weak(F.col("etag")) == weak(F.col("target.etag")), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("target.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    out = found.withColumn("status", status)
    return out.select("record_id", F.col("key").alias("canonical_url"), F.col("target.record_id").alias("target_id"), "status", F.when(F.col("status") == "resolved", merged_headers(F.col("target.headers"), F.col("headers"))).alias("headers"))


def crawl_log(pages: DataFrame) -> DataFrame:
    """A crawl log of ``pages``: every page is fetched in full and, half a minute later, revisited.

    Of ids divisible by 11 the full fetch comes after the revisit; those
    divisible by 5 have changed meanwhile; those with remainder 3 modulo 7 are
    revisited by date only, with remainder 5 without a validator.
    """
    i = F.col("page_id")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + i * 60)
    etag, modified = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')), F.date_format(at, "yyyy-MM-dd")
    p = pages.select("page_id", "url", at.alias("at"), etag.alias("tag"), modified.alias("day"))
    full = p.select(
        (i * 2).alias("record_id"), "url", F.when(i % 11 == 0, F.timestamp_seconds(F.lit(1_700_000_045) + i * 60)).otherwise(F.col("at")).alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), F.col("day").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("tag"), F.lit("Cache-Control"), F.lit("no-cache"), F.lit("Content-Length"), i.cast("string")).alias("headers"),
    )
    again = p.select(
        (i * 2 + 1).alias("record_id"), "url", F.timestamp_seconds(F.lit(1_700_000_030) + i * 60).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(i % 7 == 3, None).when(i % 7 == 5, None).when(i % 5 == 0, '"changed"').otherwise(F.concat(F.lit("W/"), F.col("tag"))).alias("etag"), F.when(i % 7 == 3, F.col("day")).alias("last_modified"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("date"), F.col("day")).alias("headers"),
    )
    return full.unionByName(again)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl log of ``pages`` with its response (-1: none), status and merged headers."""
    found = resolve_revisits(crawl_log(table(spark, sf_dir, "pages")))
    flat = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return found.select("record_id", "canonical_url", F.coalesce("target_id", F.lit(-1)).alias("target_id"), "status", F.coalesce(flat, F.lit("")).alias("headers"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag,
         strftime(make_timestamp((1700000000 + page_id * 60) * 1000000), '%Y-%m-%d') AS day,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '[?](.*)$', 1), '(^|&)(utm_[a-z]*|ref)=[^&]*', '', 'g'), '^&', '') AS kept
  FROM p
), c AS (
  SELECT page_id, tag, day, host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS key FROM q
), full_ AS (
  SELECT page_id * 2 AS record_id, key, 1700000000 + page_id * 60 + CASE WHEN page_id % 11 = 0 THEN 45 ELSE 0 END AS ts, tag AS etag, day AS last_modified, page_id FROM c
), again AS (
  SELECT page_id * 2 + 1 AS record_id, key, 1700000030 + page_id * 60 AS ts, day,
         CASE WHEN page_id % 7 IN (3, 5) THEN NULL WHEN page_id % 5 = 0 THEN '"changed"' ELSE tag END AS etag,
         CASE WHEN page_id % 7 = 3 THEN day END AS last_modified
  FROM c
), best AS (
  SELECT a.record_id, arg_max(f.record_id, f.ts * 1000000000 + f.record_id) AS target_id
  FROM again a JOIN full_ f ON a.key = f.key AND f.ts < a.ts GROUP BY a.record_id
), j AS (
  SELECT a.record_id, a.key, b.target_id, a.day, f.etag AS fetag,
    CASE WHEN b.target_id IS NULL THEN 'no_earlier'
         WHEN a.etag IS NOT NULL THEN CASE WHEN a.etag = f.etag THEN 'resolved' ELSE 'mismatch' END
         WHEN a.last_modified IS NOT NULL THEN CASE WHEN a.last_modified = f.last_modified THEN 'resolved' ELSE 'mismatch' END
         ELSE 'unverified' END AS status, f.page_id
  FROM again a LEFT JOIN best b ON a.record_id = b.record_id LEFT JOIN full_ f ON f.record_id = b.target_id
)
SELECT record_id, key AS canonical_url, coalesce(target_id, -1) AS target_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60; content-length: ' || page_id || '; content-type: text/html; date: ' || day || '; etag: ' || fetag ELSE '' END AS headers
FROM j
"""
