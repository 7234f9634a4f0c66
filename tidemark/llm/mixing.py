"""Mixing sources to target weights.

Each source's words are packed, in a pseudorandom order of its documents, into
blocks of fixed length. A source's slots are numbered and mapped through a
pseudorandom permutation of its block indexes, a new one for each pass over the
source; slots and blocks are joined by index. All slots of the mix are dealt to
output shards by one more permutation: a shard's source counts then are a
multinomial draw given the sources' totals, whichever task looks at it, and no
driver or task holds the plan of all shards.

A source's words come out as its target, rounded: the words after its last full
block close each pass, and its last slot takes a part of its block.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; documents of size 0 take no words; repeated ids are documents of their
own, but reported per row; a very long text spans many blocks, which are unfolded
where they are joined; an empty table gives no rows; extra columns are ignored,
whatever their names. The order within a source is by hash of the id, then id,
then size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_rows, broadcast_if_small, parts_for, stored, table

WORD_CLASS = "[^\\x20\\x09-\\x0D]+"
EPOCHS = 3
#: Rows that one row unfolds to at a time.
CHUNK = 1 << 13
#: Steps after which a walk over numbers outside is over; by then at most 64 such numbers are left to pass.
WALK = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def fill(sizes: list[int], weights: list[float], most: float = EPOCHS) -> list[float]:
    """Targets that share the sum of ``sizes`` by weight, none over ``most`` times its size.

    Sources that reach their limit keep it; what is left is shared again by weight.
    """
    total, target, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in sorted(open_))
        share = {i: left * weights[i] / weight for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = share[i]
            return target
        for i in over:
            target[i] = float(most * sizes[i])
            open_.remove(i)
    return target


def permuted(index: Column, n: Column, key: Column, rounds: int = 4) -> Column:
    """A pseudorandom permutation of 0..n-1.

    A Feistel network permutes a rectangle of a times b numbers, a = ceil(sqrt(n)),
    b = ceil(n / a), of which fewer than a lie outside of 0..n-1; one that leaves
    walks on along its cycle until it is back.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n / a), F.lit(1)).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        for r in range(rounds):
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, key, F.lit(r)), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(r)), a), a)
        return left * b + right

    first = once(index)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walk)


def unfolded(rows: DataFrame, count: str, name: str, parts: int) -> DataFrame:
    """``rows`` repeated with ``name`` = 0 .. count-1, in steps, so that no row unfolds in one place."""
    keys = rows.columns
    steps = [CHUNK**k for k in (3, 2, 1, 0)]
    out = rows.where(F.col(count) > 0).withColumn(name, F.lit(0).cast("long"))
    for wide, step in zip([None, *steps], steps):
        last = F.col(count) if wide is None else F.least(F.col(name) + wide, F.col(count))
        out = out.select(*keys, F.explode(F.sequence(F.col(name), last - 1, F.lit(step).cast("long"))).alias(name))
        if step == CHUNK:
            out = out.repartition(parts, *keys[:1], name)
    return out


def with_offsets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, buckets: int = 4096) -> DataFrame:
    """(doc_id, source, size, start): where each document starts in its source's order; with ``row_col``, that too.

    Prefix sums in two levels: within a slice of the hash order of a source, and
    over the slices' sums, so that no task holds a whole source.
    """
    more = [row_col] if row_col else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col).cast("string")).alias("size"), *more)
    rows = stored(rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit("order"))), "sizes")
    rows = rows.withColumn("slice", F.floor((F.col("h") / 2.0**64 + 0.5) * buckets).cast("int"))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = (rows["source"].eqNullSafe(sums["source"])) & (rows["slice"] == sums["slice"])
    return rows.join(sums, same).select("doc_id", rows["source"], "size", (F.col("base") + F.col("inner")).alias("start"), *more)


def plan(sizes: list[int], targets: list[float], block: int) -> list[tuple[int, int, int]]:
    """(words, full blocks, slots) of each source: its slots run through whole passes, then as far as the words go."""
    out = []
    for n, t in zip(sizes, targets):
        words, full = min(round(t), EPOCHS * n), n // block
        each = full + (n % block > 0)
        passes, rest = divmod(words, n) if n else (0, 0)
        out.append((words, full, passes * each + -(-rest // block)))
    return out


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int = 128, shard_slots: int = 4096, most_sources: int = 1_000_000, seed: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with offsets, sources, draws).

    documents: doc_id, source, size, start. sources: source, source_size, target,
    full (blocks), slots, number, first (slot of the mix). draws: one row for each
    slot: shard, source number, slot, epoch, block index and the words taken from the
    block's start. A block covers ``block`` words of its source (the last one what is
    left). Per-source totals, at most ``most_sources`` rows, reach the driver; more
    sources are an error.
    """
    spark = docs.sparkSession
    placed = stored(with_offsets(docs, id_col=id_col, text_col=text_col, source_col=source_col, row_col=row_col), "placed")
    totals = bounded_rows(placed.groupBy("source").agg(F.sum("size").alias("n")), most_sources, "sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in totals]
    targets = fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    planned = plan(sizes, targets, block)
    names = "source string, source_size long, target double, words long, full long, slots long, number int, first long"
    rows, first = [], 0
    for i, (r, n, t, (words, full, slots)) in enumerate(zip(totals, sizes, targets, planned)):
        rows.append((r["source"], n, t, words, full, slots, i, first))
        first += slots
    sources = spark.createDataFrame(rows, names).coalesce(1)
    slot = unfolded(sources.select("number", "source_size", "words", "full", "slots", "first"), "slots", "slot", parts_for(spark))
    each = F.col("full") + (F.col("source_size") % block > 0).cast("int")  # slots of a pass
    slot = slot.withColumn("epoch", F.floor(F.col("slot") / each).cast("long")).withColumn("place", F.col("slot") % each)
    # the block after the last full one closes a pass, so that a pass's words up to a place are known
    index = F.when(F.col("place") < F.col("full"), permuted(F.col("place"), F.greatest("full", F.lit(1)), F.xxhash64("number", "epoch", F.lit(seed)))).otherwise(F.col("full"))
    left = F.col("words") - F.col("epoch") * F.col("source_size") - F.col("place") * block
    held = F.least(F.lit(block), F.col("source_size") - F.col("place") * block)
    shard = F.floor(permuted(F.col("first") + F.col("slot"), F.lit(max(1, first)).cast("long"), F.lit(seed)) / shard_slots).cast("long")
    draws = slot.select(shard.alias("shard"), "number", "slot", "epoch", index.alias("block"), F.least(held, left).cast("long").alias("words"), (left < held).alias("part"))
    return placed, sources, draws


def pieces(placed: DataFrame, sources: DataFrame, *, block: int = 128) -> DataFrame:
    """(number, block, start, lo, hi): which words of each block are of which document."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = placed.where("size > 0").join(broadcast_if_small(sources.select("source", "number")), placed["source"].eqNullSafe(sources["source"])).select("number", "start", "size")
    rows = rows.select("*", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    return rows.select("number", "block", "start", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, and ``row_col`` if given."""
    block = options.get("block", 128)
    placed, sources, draws = mix(docs, **options)
    # of a source's draws one at most is of a part of its block
    times = draws.groupBy("number", "block").agg(F.sum((~F.col("part")).cast("long")).alias("times"), F.coalesce(F.max(F.when(F.col("part"), F.col("words"))), F.lit(0)).alias("part"))
    words = (F.col("hi") - F.col("lo")) * F.col("times") + F.greatest(F.least("hi", "part") - F.col("lo"), F.lit(0))
    # both sides grow with the input, whatever the optimizer thinks of the few rows they unfold from
    used = pieces(placed, sources, block=block).hint("merge").join(times.hint("merge"), ["number", "block"]).groupBy("number", "start").agg(F.sum(words).alias("taken"))
    right = broadcast_if_small(sources.select(F.col("source").alias("of"), "source_size", "target", "number"))
    rows = placed.join(right, placed["source"].eqNullSafe(F.col("of"))).drop("of")
    used = used.withColumn("some", F.lit(True))
    # documents of size 0 share their start with the next one
    joined = rows.withColumn("some", F.col("size") > 0).join(used, ["number", "start", "some"], "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *filter(None, [options.get("row_col")]))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
