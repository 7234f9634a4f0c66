"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. They are rotated and
split into low-dimensional blocks; each block gets a share of the squared
distance in proportion to its dimensions. A pair within the whole distance is
within the share in at least one block, so the union of the blocks' range joins
holds every pair; candidates are verified by their exact cosine. A pair that
several blocks find counts in the first of them.

A block's range join works on a grid over the block's coordinates, cut at
quantiles. A vector is owned by its cell and visits the later cells that its ball
meets. What a task receives is bounded, not only what a cell owns: a cell's own
vectors and its visitors are dealt into pieces of about ``piece_rows``, and a task
compares two pieces. Tasks return sums and a spanning set of links, never all pairs
of a group.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, not even with each other; vectors of different
length don't link; equal vectors are compared once, with their count; repeated
ids are vectors of their own; long vectors get more blocks; an empty table gives no
rows; extra columns are ignored, whatever their names. Cosines are in double
precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_rows, stored, table
from tidemark.llm.components import components, union

SLACK = 1e-9
#: Dimensions of a block. By chance a pair of isotropic vectors of 64 dimensions passes a block of 8 with 6e-5 and one of 16 with 1e-8.
WIDTH = 16


def rotation(dim: int, seed: int = 9) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def split(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, max(1, round(dim / WIDTH)) + 1).round().astype(int)
    return [slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:])]


def shares(dim: int, least: float) -> np.ndarray:
    """Each block's share of the squared distance."""
    return np.array([(2.0 - 2.0 * least + SLACK) * (s.stop - s.start) / dim for s in split(dim)])


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of any length but zero as unit vectors in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def raw_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, raw): the vector's bytes, as float if the column is of floats and else as double; null if it links with nothing."""
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast(f"array<{'float' if kind is np.float32 else 'double'}>").alias("v"))

    def run(batches):
        for b in batches:
            v = b.column(1)
            flat = v.flatten()  # without what null rows hold
            x = flat.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zero; nulls are NaN
            size = np.where(v.is_valid().to_numpy(zero_copy_only=False), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            stop = np.cumsum(size)
            sums = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[stop] - c[stop - size]
            good = (sums(~np.isfinite(x)) == 0) & (sums(x != 0) > 0)
            data = x.tobytes()
            width = np.dtype(kind).itemsize
            raw = [data[(z - n) * width : z * width] if g else None for z, n, g in zip(stop.tolist(), size.tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "raw"])

    return rows.mapInArrow(run, "id long, raw binary")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float32 if len(data) == 4 * dim * len(column) else np.float64).reshape(-1, dim)


def block_distance(x: np.ndarray, y: np.ndarray, blocks: list[slice]) -> np.ndarray:
    """Squared distance of each pair of rows in each block; the same in whichever task it is taken."""
    d = x - y
    d *= d
    return np.stack([d[:, s].sum(1) for s in blocks], axis=1)


# --- cells ------------------------------------------------------------------------------


def cell_bits(n: int, cell_rows: int, width: int) -> list[int]:
    """How often each coordinate of a block is halved, so that cells own about ``cell_rows`` of ``n`` vectors."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / cell_rows))))
    return [bits // width + (c < bits % width) for c in range(width)]


def cells_met(x: np.ndarray, cuts: list[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether the row's own) of the cells that lie within the share of each row, the own and later ones."""
    row, code, d2 = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    home = np.zeros(len(x), np.int64)
    for c, cut in enumerate(cuts):
        if not len(cut):
            continue
        home = home * (len(cut) + 1) + np.searchsorted(cut, x[:, c], side="right")
        lo, hi = np.append(-np.inf, cut), np.append(cut, np.inf)
        away = np.maximum(0.0, np.maximum(lo[None, :] - x[row, c][:, None], x[row, c][:, None] - hi[None, :]))
        d2_ = d2[:, None] + away * away
        k, slab = np.nonzero(d2_ <= share + SLACK)
        row, code, d2 = row[k], code[k] * (len(cut) + 1) + slab, d2_[k, slab]
    keep = code >= home[row]
    row, code = row[keep], code[keep]
    return row, code, code == home[row]


def spots(reps: DataFrame, dim: int, *, least: float, cell_rows: int) -> DataFrame:
    """(k, cell, own, id): the cells of block k that each vector owns or visits."""
    blocks, turn, share = split(dim), rotation(dim), shares(dim, least)
    n = reps.count()
    bits = [cell_bits(n, cell_rows, s.stop - s.start) for s in blocks]
    used = [(k, c) for k, b in enumerate(bits) for c, m in enumerate(b) if m]

    def turned(batches):
        for b in batches:
            u = units(_matrix(b.column(0), dim)) @ turn
            yield pa.RecordBatch.from_arrays([pa.array(u[:, blocks[k].start + c]) for k, c in used], [f"c{k}_{c}" for k, c in used])

    cuts = [[np.zeros(0) for _ in b] for b in bits]
    if used:
        at = reps.select("raw").mapInArrow(turned, ", ".join(f"c{k}_{c} double" for k, c in used))
        row = at.agg(*[F.percentile_approx(f"c{k}_{c}", [i / 2 ** bits[k][c] for i in range(1, 2 ** bits[k][c])], 1000).alias(f"c{k}_{c}") for k, c in used]).first()
        for k, c in used:
            cuts[k][c] = np.unique(row[f"c{k}_{c}"])

    def run(batches):
        for b in batches:
            ids, u = b.column(0).to_numpy(), units(_matrix(b.column(1), dim)) @ turn
            for k, s in enumerate(blocks):
                for lo in range(0, len(ids), 1024):
                    row, cell, own = cells_met(u[lo : lo + 1024, s], cuts[k], share[k])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(cell), pa.array(own), pa.array(ids[lo + row])], ["k", "cell", "own", "id"])

    return reps.select("id", "raw").mapInArrow(run, "k int, cell long, own boolean, id long")


def dealt(spots_: DataFrame, piece_rows: int) -> DataFrame:
    """(k, cell, i, j, right, id): tasks that compare piece i of a cell's vectors with piece j.

    Pieces of visitors come after those of the own vectors, and are right; so is
    the second of two own pieces. A cell that fits one task is the task (0, 0).
    """
    parts = lambda n: F.ceil(n / piece_rows).cast("int")
    held = spots_.groupBy("k", "cell").agg(F.sum(F.col("own").cast("long")).alias("o"), F.sum((~F.col("own")).cast("long")).alias("v"))
    one = F.col("o") + F.col("v") <= 2 * piece_rows
    held = held.where("o > 0").select("k", "cell", F.when(one, 1).otherwise(parts(F.col("o"))).alias("a"), F.when(one, 0).otherwise(parts(F.col("v"))).alias("b"))
    rows = spots_.join(held, ["k", "cell"])
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("a")).otherwise(F.greatest("b", F.lit(1)))).cast("int")
    rows = rows.withColumn("p", mine)
    other = F.when(F.col("own"), F.sequence(F.lit(0), F.col("a") + F.col("b") - 1)).otherwise(F.sequence(F.lit(0), F.col("a") - 1))
    rows = rows.select("k", "cell", "own", "id", "p", "a", "b", F.explode(other).alias("q"))
    place = F.when(F.col("own") | (F.col("b") == 0), F.col("p")).otherwise(F.col("a") + F.col("p"))
    whole = (F.col("a") == 1) & (F.col("b") == 0)
    return rows.select("k", "cell", F.least("q", place).alias("i"), F.when(whole, 0).otherwise(F.greatest("q", place)).alias("j"), F.when(whole, ~F.col("own")).otherwise(place > F.col("q")).alias("right"), "id")


def join_pieces(ids: np.ndarray, counts: np.ndarray, right: np.ndarray, unit: np.ndarray, turned: np.ndarray, block: int, least: float, inner: bool, chunk: int = 512):
    """Verified pairs of a left vector with a right one, and with ``inner`` of two left ones, chunk by chunk."""
    dim = unit.shape[1]
    blocks, share = split(dim), shares(dim, least)
    order = np.lexsort((ids, right))
    ids, counts, unit, turned = (a[order] for a in (ids, counts, unit, turned))
    lefts = int(np.count_nonzero(~right))
    x = turned[:, blocks[block]].astype(np.float32)
    norm, one = (x * x).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)
    # squared distances as one product
    a, b = np.hstack([-2 * x, norm, one]), np.ascontiguousarray(np.hstack([x, one, norm]).T)
    bar = np.float32(share[block] + 1e-5)
    for lo in range(0, lefts, chunk):
        hi = min(lo + chunk, lefts)
        for start in range(lo if inner else lefts, len(ids), 1 << 13):
            stop = min(start + (1 << 13), len(ids))
            hit = np.flatnonzero(a[lo:hi] @ b[:, start:stop] <= bar)
            if not len(hit):
                continue
            i, j = hit // (stop - start) + lo, hit % (stop - start) + start
            later = j > i
            i, j = i[later], j[later]
            for at in range(0, len(i), 50_000):
                p, q = i[at : at + 50_000], j[at : at + 50_000]
                near = block_distance(turned[p], turned[q], blocks) <= share
                here = near[:, block] & ~near[:, :block].any(1)
                p, q = p[here], q[here]
                linked = np.einsum("ij,ij->i", unit[p], unit[q]) >= least
                yield ids[p[linked]], ids[q[linked]], counts[p[linked]], counts[q[linked]]


def near_sums(reps: DataFrame, dim: int, *, least: float, piece_rows: int) -> DataFrame:
    """(a, b, n): n linked vectors of rep a where b is null, else a link of a spanning set."""
    turn = rotation(dim)
    tasks = dealt(stored(spots(reps, dim, least=least, cell_rows=piece_rows), "spots"), piece_rows).join(reps.select("id", "n", "raw"), "id")

    def join(key, t):
        ids, n, right = t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("right").to_numpy(zero_copy_only=False)
        unit = units(_matrix(t.column("raw"), dim))
        nodes = np.sort(ids)
        sums, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for a, b, na, nb in join_pieces(ids, n, right, unit, unit @ turn, key[0].as_py(), least, key[2] == key[3]):
            x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
            np.add.at(sums, x, nb)
            np.add.at(sums, y, na)
            fresh = root[x] != root[y]
            if fresh.any():
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                root = union(np.concatenate([x[fresh], moved]), np.concatenate([y[fresh], root[moved]]), len(nodes))
        some, moved = np.flatnonzero(sums), np.flatnonzero(root != np.arange(len(nodes)))
        a = np.concatenate([nodes[some], nodes[moved]])
        b = pa.array(np.concatenate([nodes[some], nodes[root[moved]]]), mask=np.arange(len(a)) < len(some))
        return pa.table({"a": pa.array(a, pa.int64()), "b": b.cast(pa.int64()), "n": pa.array(np.concatenate([sums[some], np.zeros(len(moved), np.int64)]), pa.int64())})

    return tasks.select("k", "cell", "i", "j", "right", "id", "n", "raw").groupBy("k", "cell", "i", "j").applyInArrow(join, "a long, b long, n long")


def near_groups(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, piece_rows: int = 16_384, most_lengths: int = 1000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Each length of vectors is a join of its own; over ``most_lengths`` different ones are an error.
    """
    spark = vectors.sparkSession
    rows = stored(raw_vectors(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # equal vectors: one stands for all, under a number of its own so that repeated ids don't matter
    reps = stored(rows.where("raw is not null").groupBy("raw").agg(F.min("row").alias("id"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "reps")
    width = 4 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else 8
    dim_of = (F.octet_length("raw") / width).cast("int")
    found = None
    for dim in [r["dim"] for r in bounded_rows(reps.select(dim_of.alias("dim")).distinct().orderBy("dim"), most_lengths, "vector lengths")]:
        part = near_sums(reps.where(dim_of == dim), dim, least=least, piece_rows=piece_rows)
        found = part if found is None else found.unionByName(part)
    found = stored(found if found is not None else spark.createDataFrame([], "a long, b long, n long"), "links")
    sums = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = reps.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(sums.withColumnRenamed("a", "id"), "id", "left")
    named = named.select("raw", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "raw").join(named, "raw", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op9_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_groups(table(spark, sf_dir, "embeddings"))
