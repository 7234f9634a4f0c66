"""Benchmark decontamination by Wu-Manber multi-pattern search.

Windows of benchmark words are the test strings. Text and windows are normalised
to words between single spaces, so that an occurrence is a plain substring. A
shift table over blocks of bytes skips positions at which no window can end;
where it can't skip, the block's bucket selects windows by their ends and a
direct comparison confirms them. Windows of similar length share a table, since
the shortest one bounds the skips.

Defined cases: a null or wordless text has no words, no hits and isn't
contaminated; a null or wordless item has no window; an item with fewer words
than a window is one window; items that share a window are all counted; equal
item ids count once; an item without an id is searched and makes a text
contaminated, but is not among the items found; repeated rows are each searched, and
a text of any length whole; an empty benchmark leaves all clean, an empty table gives
no rows; extra columns are ignored, whatever their names, or kept by ``clean_only``. Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_rows, stored, table

_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Lower ends of the length classes, in bytes.
CLASSES = (0, 8, 16, 32, 64)


def words(text: str | None) -> list[bytes]:
    return [w for w in (text or "").encode().translate(_WORDS).split(b" ") if w]


def windows(text: str | None, size: int) -> set[bytes]:
    """Normalised windows, each with a space at both ends."""
    w = words(text)
    return {b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))} if w else set()


class WuManber:
    """Search for patterns of at least ``shortest`` bytes."""

    def __init__(self, patterns: dict[bytes, list[int]]):
        self.shortest = m = min(map(len, patterns))
        self.block = b = max(1, min(12, m // 3))
        self.longest_shift = m - b + 1
        shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[tuple[bytes, list[int]]]] = defaultdict(list)
        for p, items in patterns.items():
            for end in range(b, m + 1):  # a pattern is represented by its first m bytes
                key = p[end - b : end]
                if m - end < shift.get(key, self.longest_shift):
                    shift[key] = m - end
            self.buckets[p[m - b : m]].append((p, items))
        self.shift = shift

    def search(self, text: bytes):
        """Yields (start, pattern, items) for every occurrence."""
        b, m, far = self.block, self.shortest, self.longest_shift
        get, buckets, n = self.shift.get, self.buckets, len(text)
        end = m
        while end <= n:
            s = get(text[end - b : end], far)
            if s:
                end += s
                continue
            start = end - m
            for p, items in buckets[text[end - b : end]]:
                if text.startswith(p, start):
                    yield start, p, items
            end += 1


class Searcher:
    """All windows of a benchmark, by length class."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        patterns: dict[bytes, list[int]] = defaultdict(list)
        self.names = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            for w in windows(text, size):
                patterns[w].append(k)
        classes: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for p, ks in patterns.items():
            classes[max(c for c in CLASSES if c <= len(p))][p] = ks
        self.tables = [WuManber(classes[c]) for c in sorted(classes)]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged runs of hit words [from, to), ids of the items found."""
        w = words(text)
        if not w or not self.tables:
            return len(w), [], set()
        joined = b" " + b" ".join(w) + b" "
        spans, found = [], set()
        for t in self.tables:
            for start, p, items in t.search(joined):
                spans.append((start, start + len(p)))
                found.update(items)
        return len(w), _runs(joined, spans), {self.names[k] for k in found if self.names[k] is not None}


def _runs(joined: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans, each from a space to a space, as merged runs of word indexes."""
    out: list[list[int]] = []
    at = word = 0
    for start, stop in sorted(spans):
        word += joined.count(b" ", at, start)  # the spaces before start are the words before it
        at = start
        lo = word
        hi = lo + joined.count(b" ", start, stop) - 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


RESULT = "doc_id {id}, n_words long, hit_runs array<struct<lo:long,hi:long>>, items array<string>"


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], size: int) -> DataFrame:
    searcher = docs.sparkSession.sparkContext.broadcast(Searcher(items, size))
    names = ["doc_id", "n_words", "hit_runs", "items"]
    runs_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [searcher.value.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([[{"lo": lo, "hi": hi} for lo, hi in x[1]] for x in found], runs_type), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))], names
            )

    return docs.mapInArrow(run, RESULT.format(id=docs.schema["doc_id"].dataType.simpleString()))


def item_blocks(items: DataFrame, block_bytes: int):
    """(i, t) rows in lists of about ``block_bytes``, one at least; one list is on the driver at a time."""
    bytes_ = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0))), F.lit(0)).alias("b")).first()["b"]
    blocks = -(-bytes_ // block_bytes) or 1
    if blocks == 1:
        yield [(r["i"], r["t"]) for r in bounded_rows(items, block_bytes, "benchmark")]
        return
    items = stored(items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(2 * blocks))), "benchmark")
    for k in range(2 * blocks):
        yield [(r["i"], r["t"]) for r in items.where(F.col("b") == k).select("i", "t").collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_bytes: int = 1_000_000) -> DataFrame:
    """One row for each document: doc_id, n_words, hit_runs (word index ranges) and items found.

    A benchmark of at most ``block_bytes`` of text is broadcast as one table (about
    150 bytes for each byte of text), in one narrow pass. A larger one is searched in blocks of that size, one pass
    each, and the passes' rows are merged by row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    blocks = item_blocks(items, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _pass(rows, first, size)
    keyed = stored(rows.withColumn("doc_id", F.struct(F.monotonically_increasing_id().alias("row"), "doc_id")), "documents")
    found = [_pass(keyed, block, size) for block in chain([first, second], blocks)]
    merged = found[0]
    for other in found[1:]:
        merged = merged.unionByName(other)
    ranges = F.array_sort(F.flatten(F.collect_list("hit_runs")))
    joined = F.aggregate(ranges, F.array().cast("array<struct<lo:bigint,hi:bigint>>"), lambda a, r: F.when((F.size(a) > 0) & (F.element_at(a, -1)["hi"] >= r["lo"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["lo"].alias("lo"), F.greatest(F.element_at(a, -1)["hi"], r["hi"]).alias("hi"))))).otherwise(F.concat(a, F.array(r))))
    return merged.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), joined.alias("hit_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "hit_runs", "items")


def n_hit():
    return F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"])


def clean_only(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_bytes: int = 1_000_000) -> DataFrame:
    """``docs`` without the contaminated ones; a narrow filter for each block of the benchmark."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    where, out = docs.columns.index(text_col), docs
    for block in item_blocks(items, block_bytes):
        searcher = docs.sparkSession.sparkContext.broadcast(Searcher(block, size))

        def run(batches, searcher=searcher):
            for b in batches:
                yield b.filter(pa.array([not searcher.value.scan(t)[1] for t in b.column(where).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's windows in every document."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))
