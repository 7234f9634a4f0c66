"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 majority bits over the hashes of word shingles. Correlated
bits are grouped into partitions; a dynamic program gives each partition its own
threshold so that the estimated number of candidates is least while every pair
within the distance still agrees in some partition. Every distinct fingerprint
is indexed by its partition values and probes the values within the threshold;
candidates are verified by their whole distance.

Defined cases: texts without words, null ones too, have fingerprint zero and link
like others; fewer words than a shingle make one shingle; a text of any length
counts whole; equal fingerprints are one node, so copies never meet in pairs; rows
that share an id link by their own fingerprints only; a row without an id links,
but gives its component no id; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, stored, table
from tidemark.llm.components import components, union

BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else 32 if i in range(9, 14) else i for i in range(256))
#: Groups of at most this many fingerprints are compared all at once; larger ones by expanding components.
SMALL = 24


def fingerprint(text: str | None, size: int = 3) -> int:
    """Majority bits of XXH64 (seed 42) over the ``size``-word shingles of the lower-cased text."""
    words = [w for w in (text or "").encode().translate(_LOWER).split(b" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, 8192):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo : lo + 8192], stops[lo : lo + 8192])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp long) in one narrow pass; ``fp`` holds the bits of the unsigned fingerprint."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


# --- partitions and thresholds -------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are both set, over all of them."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            h = b.column(0).to_numpy().view("<u8")
            x = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(h)
        i = np.repeat(np.arange(BITS), BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(np.tile(np.arange(BITS), BITS), -1).astype(np.int32)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["i", "j", "n"])

    out, n = np.zeros((BITS, BITS)), 0
    for i, j, c in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if i < 0:
            n = c
        else:
            out[i, j] = c
    return n, out


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in ``m`` partitions of nearly equal size, correlated bits together.

    Greedy: a partition starts with the least balanced free bit and takes the free
    bit with the largest mean absolute correlation to its members.
    """
    p = np.diag(both) / max(1, n)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(var, var))
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = (BITS * (k + 1)) // m - (BITS * k) // m
        first = min(free, key=lambda b: (round(p[b] * (1 - p[b]), 6), b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (round(float(corr[b, group].mean()), 6), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def estimated_candidates(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated pairs within distance 0..most of each other on the bits of ``group``.

    From how often pairs of bits are set together, over all fingerprints: the bits are
    put in a chain, each next to the one it is most correlated with, along which
    whether two random fingerprints differ in a bit depends on the bit before.
    """
    share = both / max(1, n)
    p = np.diag(share)
    one = p * p + (1 - p) ** 2  # two fingerprints agree in a bit
    two = share**2 + (p[:, None] - share) ** 2 + (p[None, :] - share) ** 2 + (1 - p[:, None] - p[None, :] + share) ** 2  # in both of two bits
    chain, left = [group[0]], set(group[1:])
    while left:
        chain.append(max(left, key=lambda b: (round(float(two[chain[-1], b] - one[chain[-1]] * one[b]), 9), -b)))
        left.remove(chain[-1])
    ways = np.zeros((most + 1, 2))  # by number of differing bits, and whether the last one agrees
    ways[0, 1] = one[chain[0]]
    ways[1:2, 0] = 1 - one[chain[0]]
    for i, j in zip(chain, chain[1:]):
        agree_agree, agree = two[i, j], one[i]
        differ_agree = max(0.0, one[j] - two[i, j])
        after_agree = min(1.0, agree_agree / agree) if agree > 0 else 0.0
        after_differ = min(1.0, differ_agree / (1 - agree)) if agree < 1 else 0.0
        new = np.zeros_like(ways)
        new[:, 1] = ways[:, 1] * after_agree + ways[:, 0] * after_differ
        new[1:, 0] = ways[:-1, 1] * (1 - after_agree) + ways[:-1, 0] * (1 - after_differ)
        ways = new
    return list(np.cumsum(ways.sum(1)) * n * (n - 1) / 2)


def _ball(size: int, t: int) -> int:
    total, c = 0, 1
    for k in range(t + 1):
        total += c
        c = c * (size - k) // (k + 1)
    return total


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1: partition unused) that sum to ``distance - m + 1`` at the least cost, by dynamic programming.

    A cost counts the rows of probes and the estimated candidates.
    """
    m = len(groups)
    budget = distance + 1  # sum of (threshold + 1)
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * budget
    for g in groups:
        pairs = estimated_candidates(n, both, g, distance)
        costs = [0.0] + [n * (1 + _ball(len(g), t)) + 0.05 * pairs[t] for t in range(distance + 1)]
        new: list[tuple[float, list[int]] | None] = [None] * (budget + 1)
        for used, state in enumerate(best):
            if state is None:
                continue
            for spend, cost in enumerate(costs):
                if used + spend <= budget and (new[used + spend] is None or state[0] + cost < new[used + spend][0]):
                    new[used + spend] = (state[0] + cost, [*state[1], spend - 1])
        best = new
    assert best[budget] is not None and len(best[budget][1]) == m
    return best[budget]


def plan(n: int, both: np.ndarray, distance: int) -> tuple[list[list[int]], list[int]]:
    """The cheapest of two to ``distance + 2`` partitions with their thresholds."""
    options = []
    for m in range(2, distance + 3):
        groups = grouped_bits(n, both, m)
        cost, limits = allocate(n, both, groups, distance)
        options.append((cost, m, groups, limits))
    _, _, groups, limits = min(options, key=lambda o: o[:2])
    return groups, limits


# --- probing -------------------------------------------------------------------------


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _flips(bits: list[int], t: int) -> np.ndarray:
    """All masks of at most ``t`` of ``bits``, none first."""
    masks = [0]
    level = [(0, -1)]
    for _ in range(t):
        level = [(m | 1 << b, k) for m, last in level for k, b in enumerate(bits) if k > last]
        masks += [m for m, _ in level]
    return np.array(masks, dtype=np.uint64)


def keys(fps: DataFrame, groups: list[list[int]], limits: list[int], split: int = 4) -> DataFrame:
    """(part, key, fp): the values that each fingerprint is indexed under and those that it probes.

    A pair that meets under part i differs elsewhere by at most the distance. The
    bits outside of the part are cut in ``split`` equal pieces, one of which then
    is equal in both, so the key takes that piece in: values shared by many
    fingerprints fall apart into many small groups.
    """
    tables = []
    for k, (bits, t) in enumerate(zip(groups, limits)):
        if t >= 0:
            outside = [b for g, other in enumerate(groups) if g != k for b in other]
            pieces = [outside[i::split] for i in range(split)]
            tables.append((k, np.uint64(_mask(bits)), _flips(bits, t), [np.uint64(_mask(x)) for x in pieces]))

    def run(batches):
        for b in batches:
            h = np.ascontiguousarray(b.column(0).to_numpy()).view(np.uint64)
            for part, mask, flips, pieces in tables:
                for q, piece in enumerate(pieces):
                    tag = np.int32(part * 16 + q)
                    for at in range(0, len(flips), 8):
                        some = flips[at : at + 8]
                        key = (((h & mask)[:, None] ^ some[None, :]) | (h & piece)[:, None]).ravel()
                        fp = np.repeat(h, len(some))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), tag, np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["part", "key", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, key long, fp long")


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def spanning(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of one group as all its links would, never all pairs.

    A breadth-first search: each member reached is compared with those not reached yet.
    """
    left, heads, tails = np.unique(fp), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = near(left, x, distance)
            if hit.any():
                got = left[hit]
                heads.append(np.full(len(got), x))
                tails.append(got)
                front.extend(got)
                left = left[~hit]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (empty, empty)


def verified(part: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of equal (part, key) of sorted arrays."""
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
    size = np.diff(np.append(first, len(key)))
    group = np.repeat(np.arange(len(first)), size)
    large = size > SMALL
    heads, tails = [], []
    few = ~large[group]
    g, f = group[few], fp[few]
    for s in range(1, SMALL):
        same = g[s:] == g[:-s]
        if not same.any():
            break
        hit = same & (f[s:] != f[:-s]) & near(f[s:], f[:-s], distance)
        heads.append(f[:-s][hit])
        tails.append(f[s:][hit])
    for k in np.flatnonzero(large):
        a, b = spanning(fp[first[k] : first[k] + size[k]], distance)
        heads.append(a)
        tails.append(b)
    empty = np.zeros(0, np.uint64)
    a, b = (np.concatenate([empty, *x]) for x in (heads, tails))
    if len(a):  # within this task, links that close a circle are dropped
        nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = union(code[: len(a)], code[len(a) :], len(nodes))
        moved = root != np.arange(len(nodes))
        return nodes[moved], nodes[root[moved]]
    return a, b


def near_links(fps: DataFrame, *, distance: int = 3) -> DataFrame:
    """(a, b): links that connect distinct fingerprints as all pairs within ``distance`` would."""
    n, both = bit_counts(fps)
    groups, limits = plan(n, both, distance)
    keyed = keys(fps, groups, limits).repartition("part", "key").sortWithinPartitions("part", "key")

    def run(batches):
        rest: tuple | None = None
        for b in batches:
            part, key, fp = b.column(0).to_numpy(), b.column(1).to_numpy(), np.ascontiguousarray(b.column(2).to_numpy()).view(np.uint64)
            if rest is not None:
                part, key, fp = (np.concatenate(x) for x in zip(rest, (part, key, fp)))
            if not len(part):
                continue
            # the last group may go on in the next batch
            open_ = int(np.argmax((part == part[-1]) & (key == key[-1])))
            rest = (part[open_:], key[open_:], fp[open_:])
            if open_:
                yield _links(part[:open_], key[:open_], fp[:open_])
        if rest is not None and len(rest[0]):
            yield _links(*rest)

    def _links(part, key, fp):
        a, b = verified(part, key, fp, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links within ``distance`` bits."""
    fps = stored(fingerprints(docs, id_col=id_col, text_col=text_col, size=size), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(near_links(classes, distance=distance))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# --- groups by similarity ------------------------------------------------------------

#: Members of a large group in a block; two blocks with their shingles are in memory at once.
BLOCK = 2048
#: Keys of a set of shingles, and the hash functions in each.
BANDS, DEPTH = 40, 4
_TURN, _TIMES = np.random.default_rng(5).integers(1 << 63, size=(2, BANDS * DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Distinct XXH64 (seed 42) of the word shingles, sorted; none for a text without words."""
    words = [w for w in (text or "").encode().translate(_LOWER).split(b" ") if w]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))] if words else [], dtype=np.uint64))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingles."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def shingle_sets(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(id, hashes): all shingle hashes of the rows (doc_id, text) whose id is among ``nodes`` (id)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t, size).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "hashes"])

    some = rows.join(nodes.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    return some.mapInArrow(run, "id long, hashes binary")


def similar_links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of ids whose whole sets have a similarity of at least ``least``."""
    side = lambda n: sets.select(F.col("id").alias(n), F.col("hashes").alias(f"s{n}"))

    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(k).to_pylist()] for k in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array([similarity(p, q) >= least for p, q in zip(x, y)], pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def band_keys(h: np.ndarray) -> np.ndarray:
    """``BANDS`` keys, each over the least values of a set under ``DEPTH`` hash functions; none for an empty set."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.full(len(_TURN), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, ((h[None, at : at + 1024] ^ _TURN[:, None]) * _TIMES[:, None]).min(axis=1))
    key = _TIMES[:BANDS].copy()
    for x in least.reshape(BANDS, DEPTH).T:
        key = (key ^ x ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(31))


def wide_links(classes: DataFrame, *, least: float = 0.8) -> DataFrame:
    """Ids (a, b) whose sets agree in a band of least hash values.

    ``classes``: id, n (size of the set) and its ``band_keys``. A pair of
    similarity s shares none of the keys with probability
    (1 - s ** DEPTH) ** BANDS, however many documents there are: 6.7e-10 at .8.
    A row is a pair whose sizes allow ``least``, or (``large``) the member b of a
    group of more than ``SMALL`` with its smallest id a: such groups are searched
    by ``links_of_large``.
    """

    def deal(batches):
        for b in batches:
            key = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            each = np.array([len(x) // 8 for x in b.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(b.column(0).to_numpy(), each)), pa.array(np.repeat(b.column(1).to_numpy(), each))], ["key", "id", "n"])

    def link(batches):
        rest: tuple | None = None
        run: tuple | None = None  # key, smallest id and size so far of a large group that goes on
        for b in batches:
            t = tuple(b.column(k).to_numpy() for k in range(3))
            if run is not None:
                others = np.flatnonzero(t[0] != run[0])
                m = int(others[0]) if len(others) else len(t[0])
                yield _members(t[0][:m], t[1][:m], run[1], run[2])
                run, t = (run[0], run[1], run[2] + m) if m == len(t[0]) else None, tuple(x[m:] for x in t)
            if rest is not None:
                t = tuple(np.concatenate(x) for x in zip(rest, t))
            if not len(t[0]):
                continue
            open_ = int(np.argmax(t[0] == t[0][-1]))
            rest = tuple(x[open_:] for x in t)
            if open_:
                yield _pairs(*(x[:open_] for x in t))
            if len(rest[0]) > SMALL:
                run, rest = (rest[0][0], rest[1][0], len(rest[0])), _emptied(rest)
                yield _members(t[0][open_:], t[1][open_:], run[1], 0)
        if rest is not None and len(rest[0]):
            yield _pairs(*rest)

    def _emptied(t):
        return tuple(x[:0] for x in t)

    def _members(key, ids, least_id, before):
        """Rows of a large group, ``before`` of whose members are out already."""
        n = len(key)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.array(key), pa.array(np.full(n, least_id)), pa.array(ids), pa.array((np.arange(n) + before) // BLOCK)], ["large", "key", "a", "b", "block"])

    def _pairs(key, ids, n):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        group, few = np.repeat(np.arange(len(first)), size), np.repeat(size <= SMALL, size)
        g, i, m = group[few], ids[few], n[few]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(1, SMALL):
            same = g[s:] == g[:-s]
            if not same.any():
                break
            fit = same & (np.minimum(m[:-s], m[s:]) >= least * np.maximum(m[:-s], m[s:]))
            a.append(i[:-s][fit])
            b.append(i[s:][fit])
        x, y = np.concatenate(a), np.concatenate(b)
        # of a large group a row for each member, beside the smallest id
        many, at = ~few, np.arange(len(key)) - np.repeat(first, size)
        where = pa.array(np.concatenate([np.zeros(len(x), bool), np.ones(int(many.sum()), bool)]))
        none = np.zeros(len(x), np.int64)
        return pa.RecordBatch.from_arrays([where, pa.array(np.append(none, key[many])), pa.array(np.append(x, ids[first][group][many])), pa.array(np.append(y, ids[many])), pa.array(np.append(none, at[many] // BLOCK))], ["large", "key", "a", "b", "block"])

    dealt = classes.select("id", "n", "bands").mapInArrow(deal, "key long, id long, n long")
    return dealt.repartition("key").sortWithinPartitions("key", "id").mapInArrow(link, "large boolean, key long, a long, b long, block long")


def spanning_similar(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of one group as all pairs of at least ``least`` would.

    A breadth-first search: each member reached is compared with all that are not
    reached yet. A member is reached by a verified link or because it shares its
    root with one that is.
    """
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    code, of = np.split(flat, np.cumsum(size)[:-1]), np.repeat(np.arange(len(sets)), size)
    left, mark = np.ones(len(sets), bool), np.zeros(int(flat.max(initial=-1)) + 1, bool)
    live, heads, tails = np.arange(len(sets)), [], []
    while left.any():
        start = left & (roots == roots[np.argmax(left)])
        front, left = list(np.flatnonzero(start)), left & ~start
        while front and left.any():
            if left.sum() * 2 < len(live):  # what is reached is not counted again
                live, keep = np.flatnonzero(left), left[of]
                flat, of = flat[keep], of[keep]
            x = front.pop()
            mark[code[x]] = True
            both = np.bincount(of[mark[flat]], minlength=len(sets))
            mark[code[x]] = False
            hit = left & (both / np.maximum(1, size + size[x] - both) >= least)
            if hit.any():
                heads.append(np.full(int(hit.sum()), ids[x]))
                tails.append(ids[hit])
                got = left & np.isin(roots, roots[hit])
                front.extend(np.flatnonzero(got))
                left = left & ~got
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *heads]), np.concatenate([none, *tails])


def links_of_large(large: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): verified links that are still missing between the members of large groups.

    ``large``: key, id, block; ``roots``: what is joined already. Groups
    that are whole drop out. Of the others each pair of blocks is searched by
    itself, so a task holds two blocks of members with their sets at a time.
    """
    rows = large.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), (F.max("block") + 1).alias("blocks")).where("lo < hi").select("key", "blocks")
    open_ = broadcast_if_small(stored(open_, "open"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("block"))))
    rows = rows.join(open_, "key").withColumn("other", other)
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "root").join(sets, "id")

    def run(group):
        a, b = spanning_similar(group["id"].to_numpy(), group["root"].to_numpy(), [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()], least)
        return pa.table({"a": a, "b": b})

    return rows.select("key", "i", "j", "id", "root", "hashes").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def fingerprint_links(prints: DataFrame, classes: DataFrame, *, distance: int) -> DataFrame:
    """(a, b): links between ids of ``classes`` that join them as all pairs of fingerprints within ``distance`` would.

    ``prints``: fp and cls of each row; ``classes``: cls and id. A fingerprint stands for the
    smallest id of a class with it; the other classes with it link to that one.
    """
    member = prints.select("fp", "cls").distinct().join(classes.select("cls", "id"), "cls").select("fp", "id")
    heads = stored(member.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    same = member.join(heads, "fp").select(F.col("head").alias("a"), F.col("id").alias("b")).where("a <> b")
    side = lambda n: heads.select(F.col("fp").alias(n), F.col("head").alias(f"h{n}"))
    near = near_links(heads, distance=distance).join(side("a"), "a").join(side("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    return same.unionByName(near)


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, distance: int | None = None, fp_size: int = 3) -> DataFrame:
    """(doc_id, component_id) over verified similarity of ``size``-word shingles of at least ``least``.

    With a ``distance`` fingerprints over ``fp_size``-word shingles within it link too, however
    similar the sets are (``near_links``, all pairs).

    Candidates of similarity are the pairs that share a key of ``wide_links``. In a group of at
    most ``SMALL`` all pairs are verified; in a larger one those with its smallest
    id, and then, as far as that leaves it in parts, all members of different
    parts (``links_of_large``). Pairs are decided on the
    whole sets of shingles, which are made anew for the documents that have a
    candidate; texts without words are alike. Rows without an id are left out.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            some = [(len(h), hashlib.md5(h.tobytes()).digest(), band_keys(h).tobytes()) for h in (shingle_hashes(t, size) for t in texts)]
            fp = np.array([0 if distance is None else fingerprint(t, fp_size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *(pa.array([x[k] for x in some], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary())))], ["doc_id", "fp", "n", "cls", "bands"])

    prints = stored(rows.mapInArrow(run, "doc_id long, fp long, n long, cls binary, bands binary"), "prints")
    classes = prints.groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    found = stored(wide_links(classes, least=least), "candidates")
    pairs = found.select("a", "b").where("a <> b").distinct()
    sets = stored(shingle_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), size), "sets")
    links = similar_links(pairs, sets, least)
    if distance is not None:
        links = links.unionByName(fingerprint_links(prints, classes, distance=distance))
    roots = components(links)
    large = found.where("large").select("key", F.col("b").alias("id"), "block")
    if not large.isEmpty():
        # what is joined already goes on as links to the roots
        more = links_of_large(large, roots, sets, least)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = classes.select("cls", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("cls", "component_id")
    return prints.select("doc_id", "cls").join(named, "cls").select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, distance: int | None = 3) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Fingerprints within ``distance`` link, and so do sets of shingles of similarity ``least``.
    Of rows that share an id one stays; rows without an id are kept.
    """
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, size=size, least=least, distance=distance)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
