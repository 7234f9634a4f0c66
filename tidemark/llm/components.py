"""Connected components of a link table, without an id of all documents on the driver.

Rounds of random-priority contraction on the cluster shrink the graph until its
links fit one task, which finishes with union-find. What is left for that task
is bounded by ``LAST_LINKS``, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

LAST_LINKS = 200_000


def union(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root of each of ``n`` nodes given links ``a[i] - b[i]``; the root is the smallest node."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = lo != hi
        if not open_.any():
            return root
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _finish(batches):
    """(a, b) links of one bounded partition -> (node, root)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = union(code[: len(a)], code[len(a) :], len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) -> (node, root) for every node with a link to another.

    Nodes of a component share a root, which is one of them (not always the
    smallest). Null ends, loops and repeated links don't matter; no links, no rows.
    """
    spark = links.sparkSession
    clean = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current, steps, round_ = stored(clean, "links"), [], 0
    while current.count() > LAST_LINKS:
        # every node moves to the neighbour (or itself) with the least random priority of this round
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("p"), c.alias("v"))
        moved = both.groupBy("a").agg(F.min(near(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least(near(F.col("a")), F.col("m"))["v"].alias("root"))
        step = stored(moved, "step")
        steps.append(step)
        left = current.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        current = stored(left.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        round_ += 1
    roots = current.coalesce(1).mapInArrow(_finish, "node long, root long")
    for step in reversed(steps):
        last = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        below = step.join(last, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = stored(below, "roots")
    return roots if steps else stored(roots, "roots")
