"""Exact substring deduplication over the suffixes of a corpus, with a difference cover.

A byte is removed if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Suffixes matter up to that depth only.

1. Suffixes that can tie. The least hash among the short strings (grams) inside of
   a window of ``length`` bytes is the same wherever the window occurs, so a window
   whose least gram occurs in one document only has no equal. Grams are compared by
   hash here; that can let a window pass in vain, and never drops one.
2. Buckets. What is left is dealt by that gram. Windows with the same gram are
   neighbours and travel as one snippet of text, each once from a block. A bucket is worked on by itself: its cover sample (positions whose
   remainder lies in a difference cover, with strings of ``length - v + 1`` bytes)
   is ranked by bytes, then suffixes are sorted by their first eight bytes, and ties
   that last longer are resolved by the rank of the first sampled position after
   them, and by the last bytes, which that rank does not reach. So memory is that
   of one bucket, and equality is one of bytes, never of hashes.
3. The smallest id of each string goes back to the blocks that hold it.

Documents are held in blocks, a table bucketed by block that is read in place in
each step. A block sends a row for each of its distinct grams, so the rows grow in
proportion to the text, and a string that all documents share is one row a block.
A gram of more than ``bucket_rows`` occurrences is in no bucket: its suffixes are
grouped one by one (``_one_by_one``), with partial sums and the same result.

Defined cases: a null text is empty; a text shorter than ``length`` keeps all; a
text longer than a block is a block of its own size and is scanned in pieces; rows
that share an id don't remove from one another; a null id counts as larger than
any other; matches never cross documents; an empty table gives no rows; extra
columns are ignored, or returned as they are by ``deduplicated``, whatever their
names. Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed, parts_for, stored, table

#: Perfect difference sets by modulus: every remainder is the difference of one pair.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18)}
NO_ID = (1 << 63) - 1
_K1 = np.uint64(0x9E3779B97F4A7C15)
#: Positions scanned at a time, and snippets whose suffixes are in memory at a time.
PIECE, SNIPPETS = 1 << 16, 1 << 14
#: Snippets of a row in which a block keeps them.
PACK = 1024


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest modulus that leaves sampled strings of three quarters of ``length``."""
    fit = [v for v in COVERS if length - v + 1 >= max(8, length * 3 // 4)]
    if not fit:
        raise ValueError("strings of under 24 bytes are not supported")
    return max(fit), COVERS[max(fit)]


class Shape:
    """Lengths that follow from ``length``, the same in every task."""

    def __init__(self, length: int):
        self.length = length
        self.v, self.cover = cover_for(length)
        self.depth = length - self.v + 1
        self.gram = max(8, min(20, length * 2 // 5), length - 127)
        #: Starts of grams in a window, and so the most windows that share a gram.
        self.starts = length - self.gram + 1
        #: Bytes around a gram that its windows can reach.
        self.width = length + self.starts - 1
        #: From each remainder, the way to the next sampled position.
        self.shift = np.array([min(s for s in range(self.v) if (c + s) % self.v in self.cover) for c in range(self.v)])


def _offsets(n: int) -> list[int]:
    """Where words of eight bytes start that together cover ``n`` bytes."""
    return [*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]


# --- blocks -----------------------------------------------------------------------------


class Block:
    """Documents of one block, end to end, sorted by id."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], reach: int):
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.texts = [texts[k] for k in self.order]
        self.lens = np.fromiter(map(len, self.texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lens) - self.lens
        self.n = int(self.lens.sum())
        # ``reach`` bytes before the first text, so that a snippet never starts outside
        self.reach = reach
        self.data = np.frombuffer(b"".join([b"\0" * reach, *self.texts, b"\0" * (reach + 64)]), np.uint8)
        # equal ids are one document: they take the place of the first of them
        self.place = np.searchsorted(self.ids, self.ids)

    def docs(self, at: np.ndarray) -> np.ndarray:
        """Index of the document of each position."""
        return np.searchsorted(self.starts, at, side="right") - 1


def least_grams(block: Block, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram's position, its hash, first window, number of windows) of every gram that is the least of some window.

    Of equal grams in a window the first counts. Windows of a gram are neighbours.
    """
    w = shape.starts
    words = np.ndarray((len(block.data) - 7,), "<u8", buffer=block.data, strides=(1,))[block.reach :]
    whole = np.ones(block.n, bool)
    for s, e in zip(block.starts.tolist(), (block.starts + block.lens).tolist()):
        whole[max(s, e - shape.length + 1) : e] = False
    found = []
    for lo in range(0, block.n, PIECE):
        hi = min(lo + PIECE, block.n)
        j = np.flatnonzero(whole[lo:hi])
        if not len(j):
            continue
        size = hi - lo + w - 1
        h = np.full(size, np.uint64(shape.gram))
        for off in _offsets(shape.gram):
            h ^= words[lo + off : lo + off + size]
            h *= _K1
            h ^= h >> np.uint64(29)
        off, cur = np.zeros(size, np.uint8), 1
        while cur < w:
            step = min(cur, w - cur)
            right = h[step:] < h[:-step]
            off = np.where(right, off[step:] + np.uint8(step), off[:-step])
            h = np.where(right, h[step:], h[:-step])
            cur += step
        p, g = j + off[j], h[j]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        found.append((p[first] + lo, g[first], j[first] + lo, np.diff(np.append(first, len(j)))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, g, j, n = (np.concatenate(x) for x in zip(*found))
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))  # a gram's windows may go on in the next piece
    return p[first], g[first], j[first], np.add.reduceat(n, first)


def grams_of(block: Block, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a block's least grams, how often each occurs, and whether two of its documents have it."""
    _, g, j, _ = least_grams(block, shape)
    if not len(g):
        return g, np.zeros(0, np.int64), np.zeros(0, bool)
    place = block.place[block.docs(j)]
    order = np.argsort(g, kind="stable")  # positions, and so places, ascend within a hash
    k, place = g[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    stop = np.append(first[1:], len(k))
    return k[first], stop - first, place[first] != place[stop - 1]


def snippets_of(block: Block, shape: Shape, shared: np.ndarray):
    """Snippets of a block around the grams whose hashes are ``shared`` (sorted).

    Returns the distinct ones (gram's hash, bytes, smallest id) and for each
    occurrence its first window, its number of windows, the index of its snippet and
    whether a smaller id of this block has the snippet too. A snippet's bytes are
    those of its windows in their place around the gram, zero elsewhere, then where
    its windows start and how many they are.
    """
    p, g, j, n = least_grams(block, shape)
    hit = np.flatnonzero(_among(g, shared))
    p, g, j, n = p[hit], g[hit], j[hit], n[hit]
    rows = np.zeros((len(p), shape.width + 2), np.uint8)
    around = np.lib.stride_tricks.sliding_window_view(block.data, shape.width)
    rel = j - p + shape.starts - 1
    column = np.arange(shape.width)
    for lo in range(0, len(p), SNIPPETS):
        at = slice(lo, lo + SNIPPETS)
        a, z = rel[at, None], (rel + n - 1 + shape.length)[at, None]
        rows[at, :-2] = around[p[at] - shape.starts + 1 + block.reach] * ((column >= a) & (column < z))
    rows[:, -2], rows[:, -1] = rel, n
    doc = block.docs(j)
    kinds, first, index = np.unique(rows.view(f"V{shape.width + 2}").ravel(), return_index=True, return_inverse=True)
    # documents are in the order of ids, so the first occurrence has the smallest
    later = block.place[doc] != block.place[doc[first]][index]
    return (g[first], rows[first], block.ids[doc[first]]), (j, n, index, later)


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


# --- buckets ----------------------------------------------------------------------------


def _words(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at each position, in the order of bytes."""
    return np.ndarray((len(flat) - 7,), "<u8", buffer=flat, strides=(1,))[at].byteswap()


def cover_ranks(flat: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, equal for equal strings, of the ``depth`` bytes at each position, by sorting these."""
    keys = [_words(flat, at + off) for off in _offsets(depth)]
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(at), bool)
    for k in keys:
        s = k[order]
        fresh[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(at), np.int64)
    ranks[order] = np.cumsum(fresh)
    return ranks


def suffix_leasts(rows: np.ndarray, group: np.ndarray, least: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id among the equal strings, row) of every suffix of the snippets, which are in rows' order.

    Equal suffixes have the same gram in the same place, so they start in the same
    column, and one shift takes all of them into the cover sample.
    """
    width, length = shape.width, shape.length
    start, n = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    flat = np.concatenate([rows[:, :-2].ravel(), np.zeros(64, np.uint8)])
    row = np.repeat(np.arange(len(rows)), n)
    column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    at = row * width + column
    ahead = at + shape.shift[column % shape.v]
    sampled = np.zeros(len(rows) * width, bool)
    sampled[ahead] = True
    sampled = np.flatnonzero(sampled)
    rank = np.zeros(len(rows) * width, np.int64)
    rank[sampled] = cover_ranks(flat, sampled, shape.depth)
    heads = [_words(flat, at + off) for off in range(0, int(shape.shift.max()), 8)]
    tails = [_words(flat, at + length - off) for off in range(8 * -(-(shape.v - 1) // 8), 0, -8)]
    keys = [group[row] * width + column, *heads, rank[ahead], *tails]
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(at), bool)
    fresh[1:] = False
    for k in keys:
        s = k[order]
        fresh[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(fresh)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(least[row][order], first), np.diff(np.append(first, len(at))))
    return out, row


_ANSWER = pa.schema([("block", pa.int32()), ("index", pa.int32()), ("id", pa.int64()), ("leasts", pa.binary())])
_EACH = ("block", "index", "id", "g", "snip")


def _settled(t: tuple, shape: Shape):
    """Answers to the occurrences (block, index, id, gram, snippet) of whole grams, sorted by gram: ids of all suffixes, where one is smaller."""
    block, index, ids, g, rows = t
    if not len(g):
        return
    kinds, first, kind = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(kinds), NO_ID, np.int64)
    np.minimum.at(least, kind, ids)
    group = np.unique(g[first], return_inverse=True)[1]
    low, leasts = least.copy(), least.astype("<i8").view("V8").tolist()
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(several):
        some = several[np.argsort(group[several], kind="stable")]
        got, row = suffix_leasts(rows[first[some]], group[some], least[some], shape)
        edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        low[some] = np.minimum.reduceat(got, edge)
        mixed = np.maximum.reduceat(got, edge) != low[some]
        data, stop = got.astype("<i8").tobytes(), np.append(edge[1:], len(got))
        for k, a, z, each in zip(some.tolist(), (edge * 8).tolist(), (stop * 8).tolist(), mixed.tolist()):
            leasts[k] = data[a:z] if each else data[a : a + 8]
    hit = np.flatnonzero(low[kind] < ids)
    values = [leasts[k] for k in kind[hit].tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(block[hit]), pa.array(index[hit]), pa.array(ids[hit]), pa.array(values, pa.binary())], schema=_ANSWER)


def bucket_answers(each: DataFrame, shape: Shape) -> DataFrame:
    """(block, index, id, leasts): for each occurrence of a snippet the smallest ids of its suffixes, or one for all of them.

    ``each`` has grams of a bounded number of occurrences only; a task holds those of
    about ``SNIPPETS`` at a time.
    """
    width = shape.width + 2

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append((*(b.column(k).to_numpy() for k in range(4)), np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, width)))
            rows += len(b)
            if rows < SNIPPETS:
                continue
            t = tuple(np.concatenate(x) for x in zip(*held))
            open_ = int(np.argmax(t[3] == t[3][-1]))  # the last gram may go on in the next batch
            yield from _settled(tuple(x[:open_] for x in t), shape)
            held, rows = [tuple(x[open_:].copy() for x in t)], len(t[3]) - open_
        if held:
            yield from _settled(tuple(np.concatenate(x) for x in zip(*held)), shape)

    dealt = each.select(*_EACH).repartition(parts_for(each.sparkSession), "g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "block int, index int, id long, leasts binary")


def _one_by_one(each: DataFrame, shape: Shape) -> DataFrame:
    """The same as a bucket for grams with too many occurrences: suffixes of distinct snippets are rows, grouped by their bytes."""
    width, length = shape.width, shape.length
    kinds = stored(each.groupBy("g", "snip").agg(F.min("id").alias("least")), "snippets")
    number = lambda k: F.conv(F.hex(F.substring("snip", width + k, 1)), 16, 10).cast("int")
    rows = kinds.select("g", "snip", "least", F.explode(F.sequence(number(1), number(1) + number(2) - 1)).alias("c")).withColumn("string", F.expr(f"substring(snip, c + 1, {length})"))
    ids = rows.groupBy("g", "c", "string").agg(F.min("least").alias("smallest"))
    all_ = rows.join(ids, ["g", "c", "string"]).groupBy("g", "snip").agg(F.array_sort(F.collect_list(F.struct("c", "smallest"))).alias("ids"))

    def run(batches):
        for b in batches:
            leasts = [np.array([x["smallest"] for x in v], "<i8").tobytes() for v in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(leasts, pa.binary())], ["block", "index", "id", "leasts"])

    met = each.join(all_, ["g", "snip"]).where(F.array_min(F.col("ids.smallest")) < F.col("id"))
    return met.select("block", "index", "id", "ids").mapInArrow(run, "block int, index int, id long, leasts binary")


# --- the whole --------------------------------------------------------------------------


def blocks_of(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, carried: list[str]) -> DataFrame:
    """The corpus as a table bucketed by block: block, id, own, text, rest."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))
    rest = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("own"), text.alias("text"), rest.alias("rest"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    number = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("own", F.octet_length("text")), F.lit(number)).cast("int")
    rows = rows.select(block.alias("block"), F.coalesce("own", F.lit(NO_ID)).alias("id"), "own", "text", "rest")
    return bucketed(rows, "blocks", "block", max(1, min(parts_for(docs.sparkSession), -(-number // 4))))


def _runs(spots: pa.Table, answers: pa.Table, shape: Shape) -> pa.Table:
    """(block, starts, stops) of the bytes to remove, from a block's occurrences and the ids that came back."""
    number = spots.column("block")[0] if len(spots) else answers.column("block")[0]
    j, n, index, later = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in spots.column(c).to_pylist())]) for c, kind in (("j", "<i8"), ("n", "u1"), ("index", "<i4"), ("later", "?")))
    size = int(index.max(initial=-1)) + 1
    # ids of all windows of a snippet, as far as something comes back for it
    windows = np.zeros(size, np.int64)
    windows[index] = n
    base = np.cumsum(windows) - windows
    gone = np.zeros(int(windows.sum()), bool)
    for k, own, leasts in zip(answers.column("index").to_pylist(), answers.column("id").to_pylist(), answers.column("leasts").to_pylist()):
        gone[base[k] : base[k] + windows[k]] = np.frombuffer(leasts, "<i8") < own
    n = n.astype(np.int64)
    each = np.repeat(np.arange(len(j)), n)
    step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    hit = np.repeat(later, n)
    if len(gone):
        hit |= gone[base[index[each]] + step]
    at = np.sort((j[each] + step)[hit])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return pa.table({"block": pa.array([number.as_py()], pa.int32()), "starts": pa.array([at[first].astype("<i8").tobytes()], pa.binary()), "stops": pa.array([(at[last] + shape.length).astype("<i8").tobytes()], pa.binary())})


def _masks(block: Block, runs: pa.Table) -> list[np.ndarray]:
    """Removed bytes of each document; runs may overlap, within a document only."""
    starts, stops = (np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(x, "<i8") for x in runs.column(c).to_pylist())]) for c in ("starts", "stops"))
    # runs of neighbouring documents may touch, but a document's own bytes are counted in its own mask
    mask = np.zeros(block.n, bool)
    for a, z in zip(starts.tolist(), stops.tolist()):
        mask[a:z] = True
    return [mask[s : s + k] for s, k in zip(block.starts.tolist(), block.lens.tolist())]


def _remove_map(docs: DataFrame, id_col: str, text_col: str, length: int, block_bytes: int, bucket_rows: int, emit, schema: str, carried: list[str] | None = None) -> DataFrame:
    """``emit(block, rows, removed masks)`` for every block; rows and masks are in the block's order."""
    shape = Shape(length)
    table_ = blocks_of(docs, id_col, text_col, block_bytes, carried or [])
    slim = table_.select("block", "id", "text")

    def block_of(t: pa.Table) -> Block:
        return Block(t.column("id").to_numpy(), t.column("text").to_pylist(), shape.starts)

    def grams(key, t):
        g, times, several = grams_of(block_of(t), shape)
        return pa.table({"g": pa.array(g.view(np.int64)), "block": pa.array(np.full(len(g), key[0].as_py(), np.int32)), "times": pa.array(np.where(several, -times, times).astype(np.int32))})

    rows = slim.groupBy("block").applyInArrow(grams, "g long, block int, times int")
    # one row for each gram and block: a gram that all documents have is as many rows as there are blocks
    whole = "over (partition by g)"
    counted = rows.repartition(parts_for(docs.sparkSession), "g").selectExpr("g", "block", f"count(1) {whole} > 1 or min(times) {whole} < 0 as shared", f"sum(abs(times)) {whole} > {bucket_rows} as hot")
    shared = counted.where("shared").select("g", "block", "hot")

    def spots(key, t, hits):
        if not len(hits) or not len(t):
            return _SPOTS.empty_table()
        shared, hot = hits.column("g").to_numpy().view(np.uint64), hits.column("hot").to_numpy(zero_copy_only=False)
        (g, snips, ids), (j, n, index, later) = snippets_of(block_of(t), shape, np.sort(shared))
        values = [g, snips, ids.astype("<i8"), _among(g, np.sort(shared[hot])), j.astype("<i8"), n.astype("u1"), index.astype("<i4"), later]
        at = range(0, len(j), PACK)  # no more snippets than occurrences
        packs = [pa.array([v[k : k + PACK].tobytes() for k in at], pa.binary()) for v in values]
        return pa.table([pa.array([key[0].as_py()] * len(at), pa.int32()), pa.array(list(at), pa.int32()), *packs], schema=_SPOTS)

    held = stored(slim.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(spots, "block int, base int, " + ", ".join(f"{c} binary" for c in _SPOTS.names[2:])), "spots")
    width = shape.width + 2

    def unfold(batches):
        for b in batches:
            for block, base, g, snips, ids, hot in zip(*(b.column(k).to_pylist() for k in range(6))):
                n = len(ids) // 8
                parts = np.frombuffer(snips, f"V{width}").tolist()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.arange(base, base + n, dtype=np.int32)), pa.array(np.frombuffer(ids, "<i8")), pa.array(np.frombuffer(g, "<i8")), pa.array(parts, pa.binary()), pa.array(np.frombuffer(hot, "?"))], [*_EACH, "hot"])

    each = held.select("block", "base", "g", "snips", "ids", "hot").mapInArrow(unfold, "block int, index int, id long, g long, snip binary, hot boolean")
    few, many = each.where("not hot"), each.where("hot")
    answers = stored(bucket_answers(few, shape).unionByName(_one_by_one(many, shape)), "answers")
    runs = held.select("block", "j", "n", "index", "later").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _runs(a, b, shape), "block int, starts binary, stops binary")

    def finish(t, r):
        block = block_of(t)
        return emit(block, t.select(["own", "rest"]).take(pa.array(block.order)), _masks(block, r))

    return table_.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(finish, schema)


_SPOTS = pa.schema([("block", pa.int32()), ("base", pa.int32()), *((c, pa.binary()) for c in ("g", "snips", "ids", "hot", "j", "n", "index", "later"))])


def _spans(mask: np.ndarray) -> int:
    return int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if len(mask) else 0


def removal_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = 8_000_000, bucket_rows: int = 65_536) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def emit(block: Block, rows: pa.Table, masks: list[np.ndarray]) -> pa.Table:
        removed, spans, digest = [], [], []
        for text, m in zip(block.texts, masks):
            n = int(np.count_nonzero(m))
            removed.append(n)
            spans.append(_spans(m) if n else 0)
            digest.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~m].tobytes() if n else text).hexdigest())
        return pa.table({"doc_id": rows.column("own"), "n_bytes": pa.array(map(len, block.texts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return _remove_map(docs, id_col, text_col, length, block_bytes, bucket_rows, emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = 8_000_000, bucket_rows: int = 65_536) -> DataFrame:
    """``docs`` with what is left of each text; all other columns as they are.

    A character of which only some bytes are covered is kept whole, so that the
    text stays valid. A null text stays null.
    """
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name != text_col]

    def emit(block: Block, rows: pa.Table, masks: list[np.ndarray]) -> pa.Table:
        left = []
        for text, m in zip(block.texts, masks):
            if m.any():
                raw = np.frombuffer(text, np.uint8)
                char = np.cumsum((raw & 0xC0) != 0x80) - 1
                whole = np.ones(char[-1] + 1, bool)
                whole[char[~m]] = False
                left.append(raw[~whole[char]].tobytes().decode())
            else:
                left.append(text.decode())
        return pa.table({"rest": rows.column("rest"), "left": pa.array(left, pa.string())})

    rest = ", ".join(f"`{n}`: {k}" for n, k in kinds)
    carried = [n for n, _ in kinds]
    flagged = docs.withColumn("__null", F.col(f"`{text_col}`").isNull())
    out = _remove_map(flagged, id_col, text_col, length, block_bytes, bucket_rows, emit, f"rest struct<{rest}, `__null`: boolean>, left string", [*carried, "__null"])
    text = F.when(~F.col("rest.__null"), F.col("left"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 50 bytes take from every document."""
    return removal_digests(table(spark, sf_dir, "documents"))
