"""Revisits, SimHash, leaks, mixing, embeddings, passages: against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, decontaminate, embed_join, mixing, simhash, suffix_dedup, warc


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, block string")


def test_components(spark, monkeypatch):
    rnd = random.Random(1)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1300)] + [(5, 5), (7, None)]
    g = Groups()
    for a, b in links:
        if b is not None and a != b:
            g.join(a, b)
    for bound in (components.LAST_LINKS, 40):
        monkeypatch.setattr(components, "LAST_LINKS", bound)
        got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
        by = {}
        for r in got:
            by.setdefault(r["root"], set()).add(r["node"])
        want = {}
        for x in list(g.up):
            want.setdefault(g.find(x), set()).add(x)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("ab cd ef gh ij kl Mn op".split()) for _ in range(n)) for n in (1, 2, 3, 60, 200)]
    rows = [(i, t) for i, t in enumerate(base * 2)]
    rows += [(100 + k, re.sub(r"\bab\b", "zz", base[4], count=k)) for k in range(40)] + [(200, None), (201, ""), (202, " \t"), (5, base[3]), (300, "w" * 100_000)]
    g, fps = Groups(), [(i, brute_print(t)) for i, t in rows]
    for _, f in fps:
        for _, h in fps:
            if bin(f ^ h).count("1") <= 3:
                g.join(f, h)
    least = {}
    for i, f in fps:
        least[g.find(f)] = min(i, least.get(g.find(f), i))
    got = simhash.near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == sorted((i, f, least[g.find(f)]) for i, f in fps)
    assert simhash.near_groups(frame(spark, [])).count() == 0


def test_similar_groups(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [[word() for _ in range(n)] for n in (1, 3, 30, 90, 400, 1500)]
    rows = []
    for k, t in enumerate(texts):
        rows.append((k, " ".join(t)))
        rows.append((100 + k, " ".join(t).upper()))
        for j in range(3):
            edit = list(t)
            for at in rnd.sample(range(len(t)), len(t) // 100):
                edit[at] = word()
            rows.append((200 + 10 * k + j, " ".join(edit)))
        half = list(t)
        for at in range(0, len(t), 4):
            half[at] = word()
        rows.append((300 + k, " ".join(half)))
    rows += [(400, None), (401, ""), (400, None)]
    sets = {i: simhash.shingle_hashes(t, 5) for i, t in rows}
    g = Groups()
    for i, x in sets.items():
        g.find(i)
        for j, y in sets.items():
            both = len(np.intersect1d(x, y))
            if both >= 0.8 * (len(x) + len(y) - both):
                g.join(i, j)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == {i: g.find(i) for i in sets}
    kept = sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, [*rows, (None, "x")])).collect() if r["doc_id"] is not None)
    assert kept == sorted(set(got.values()))
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def test_similarity_is_decided_on_whole_texts(spark):
    """Pairs of long texts on either side of .8, within the error of any sketch."""
    rows, want = [], {}
    for k in range(12):
        base = [f"w{k}x{i}" for i in range(404)]  # 400 shingles
        for j, fresh in ((0, 0), (1, 45 if k % 2 else 43)):  # from the end on: 400 - fresh shingles in common
            rows.append((10 * k + j, " ".join(base[: len(base) - fresh] + [f"y{k}z{i}" for i in range(fresh)])))
        want |= {10 * k: 10 * k, 10 * k + 1: 10 * k + k % 2}
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()} == want


def test_copies_that_only_the_original_joins(spark):
    """Hundreds of edited copies, alike to the original only, which has the largest id."""
    rnd = random.Random(13)
    text = [f"w{i}" for i in range(400)]
    rows = [(9999, " ".join(text))]
    for k in range(300):
        edit = list(text)
        for at in rnd.sample(range(2, 398), 8):
            edit[at] = f"e{k}x{at}"
        rows.append((k + 5, " ".join(edit)))
    sets = [simhash.shingle_hashes(t, 5) for _, t in rows]
    assert all(simhash.similarity(sets[0], x) >= 0.8 for x in sets) and simhash.similarity(sets[1], sets[2]) < 0.8
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for most in ("10000", "37"):  # large groups go over the ends of batches
        spark.conf.set(key, most)
        try:
            assert {r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()} == {5}
        finally:
            spark.conf.unset(key)


def test_template_family_loses_no_twins(spark):
    """Texts of one template below .8 to one another, some with a twin: each twin is with its own."""
    rnd = random.Random(15)
    template, rows = [f"t{i}" for i in range(120)], []
    for k in range(3000):
        text = list(template)
        for at in range(6, 114, 9):
            text[at] = f"v{k}x{at}"
        rows.append((k, " ".join(text)))
    twins = {k: 10_000 + k for k in rnd.sample(range(3000), 100)}
    rows += [(i, rows[k][1] + " more") for k, i in twins.items()]
    a, b, c = (simhash.shingle_hashes(t, 5) for t in (rows[0][1], rows[1][1], " ".join(template)))
    assert simhash.similarity(a, b) < 0.8 and simhash.similarity(a, c) < 0.8
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows[:3000]} | {i: k for k, i in twins.items()}


def test_pairs_far_apart_in_fingerprints(spark):
    """Short texts of similarity .8 and more whose fingerprints differ in over 12 bits."""
    rnd = random.Random(14)
    rows, k = [], 0
    while k < 20:
        text = [f"a{rnd.randrange(10**6)}" for _ in range(9)]
        pair = " ".join(text[:8]), " ".join(text)
        if (simhash.fingerprint(pair[0]) ^ simhash.fingerprint(pair[1])).bit_count() > 12:
            rows += [(10 * k, pair[0]), (10 * k + 1, pair[1])]
            k += 1
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_pigeonhole_loses_no_pair():
    rng = np.random.default_rng(3)
    for skew in (0.5, 0.05):
        x = rng.random((300, 64)) < skew
        x[:, 1] = x[:, 0]
        groups, limits = simhash.plan(300, x.T.astype(float) @ x.astype(float), 3)
        assert sorted(b for g in groups for b in g) == list(range(64)) and sum(t + 1 for t in limits) == 4
        for _ in range(2000):
            flipped = set(rng.choice(64, 3, replace=False).tolist())
            assert any(t >= 0 and len(flipped & set(g)) <= t for g, t in zip(groups, limits))


def test_estimates_follow_the_counts():
    """Against all pairs, on bits of which some are copies of others."""
    rng = np.random.default_rng(6)
    bits = rng.random((1500, 64)) < rng.uniform(0.2, 0.8, 64)
    bits[:, 1], bits[:, 2], bits[:, 3] = bits[:, 0], bits[:, 0], bits[:, 0] ^ (rng.random(1500) < 0.1)
    both = bits.T.astype(float) @ bits
    for group in ([0, 1, 2, 3], [0, 5, 6, 7, 8], [10, 11, 12]):
        x = bits[:, group].astype(np.int8)
        apart = (x[:, None, :] != x[None, :, :]).sum(2)[np.triu_indices(len(x), 1)]
        want = [(apart <= t).sum() for t in range(4)]
        assert np.allclose(simhash.estimated_candidates(len(x), both, group, 3), want, rtol=0.1)


def test_spanning_large_group():
    rng = np.random.default_rng(4)
    f = np.uint64(rng.integers(1 << 60)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    a, b = simhash.spanning(f, 3)
    assert len(a) == len(np.unique(f)) - 1


def test_leaks(spark):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([("b1", item), ("b2", "Short One"), ("b3", None), ("b4", "--"), ("b1", item), ("b5", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id string, text string")
    rows = [(1, "x " + item.upper() + " y"), (2, " ".join(f"w{i}" for i in range(9))), (3, "a short, ONE b"), (4, None), (5, ""), (6, "shorty one"), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3000), (1, "short one short one")]
    got = {(r["doc_id"], r["n_words"]): (sum(x["hi"] - x["lo"] for x in r["hit_runs"]), r["items"]) for r in decontaminate.find_contamination(frame(spark, rows), bench).collect()}
    want = {(1, 16): (14, ["b1", "b5"]), (2, 9): (0, []), (3, 4): (2, ["b2"]), (4, 0): (0, []), (5, 0): (0, []), (6, 2): (0, []), (7, 30000): (30000, ["b1", "b5"]), (1, 4): (4, ["b2"])}
    assert got == want
    blocks = {(r["doc_id"], r["n_words"]): (sum(x["hi"] - x["lo"] for x in r["hit_runs"]), r["items"]) for r in decontaminate.find_contamination(frame(spark, rows), bench, block_bytes=30).collect()}
    assert blocks == want
    assert sorted(r["doc_id"] for r in decontaminate.clean_only(frame(spark, rows), bench, block_bytes=30).collect()) == [2, 4, 5, 6]
    assert decontaminate.clean_only(frame(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.find_contamination(frame(spark, []), bench).count() == 0


def test_leaks_of_whole_table(spark, sf):
    """All documents against every window of every item, word by word."""
    pattern = re.compile(rb"[0-9a-z\x80-\xff]+")
    words = lambda t: [w.decode(errors="surrogateescape") for w in pattern.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))]
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(r["item_id"]))
    sizes, want = {len(w) for w in windows}, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w, hit, items = words(r["text"]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        want[r["doc_id"]] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.op6_decontaminate(spark, sf).collect()}
    assert got == want and any(x[4] for x in got.values())


def test_leaks_of_items_without_id(spark):
    bench = spark.createDataFrame([(None, "Short One"), ("b1", "other words")], "item_id string, text string")
    rows = [(1, "a short, ONE b"), (2, "short one other words"), (3, "none")]
    for size in (16_000_000, 10):
        got = {r["doc_id"]: (sum(x["hi"] - x["lo"] for x in r["hit_runs"]), r["items"]) for r in decontaminate.find_contamination(frame(spark, rows), bench, block_bytes=size).collect()}
        assert got == {1: (2, []), 2: (4, ["b1"]), 3: (0, [])}


def test_wu_manber_is_plain_search():
    rnd = random.Random(5)
    text = bytes(rnd.choice(b"ab ") for _ in range(3000))
    patterns = {bytes(rnd.choice(b"ab ") for _ in range(n)): [n] for n in (3, 4, 5, 9, 9)}
    want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
    assert sorted((i, p) for i, p, _ in decontaminate.WuManber(patterns).search(text)) == want


def test_fill():
    assert mixing.fill([100, 100], [1, 3]) == [50, 150]
    assert mixing.fill([10, 100, 100], [100, 1, 1]) == [30, 90, 90]
    assert mixing.fill([], []) == [] and mixing.fill([0, 10], [1, 1]) == [0.0, 10.0]


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randrange(400), rnd.choice(["a", "b", None]), "x") for i in range(300)] + [(1000, None, "a", "x"), (1001, "", "c", "x"), (5, "dup " * 50, "a", "x"), (None, "no id " * 10, "b", "x"), (2000, "long " * 30_000, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.taken(df).collect()
    again = mixing.taken(df.repartition(7)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"])
    assert [r["taken"] for r in sorted(got, key=key)] == [r["taken"] for r in sorted(again, key=key)]
    for s in ("a", "b", None):
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sum(r["size"] for r in mine)}
        assert sum(r["taken"] for r in mine) == round(mine[0]["target"])
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.taken(df.limit(0)).count() == 0


def test_draws_are_as_counted_by_hand(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(1, 300), rnd.choice("ab")) for i in range(80)] + [(100 + i, "w " * 5, "c") for i in range(5)] + [(200, "w " * 1000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, sources, draws = (x.collect() for x in mixing.mix(df, block=16, shard_slots=10))
    taken = Counter()
    for s in sources:
        mine = sorted((r for r in draws if r["number"] == s["number"]), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(s["slots"]))
        assert sum(r["words"] for r in mine) == round(s["target"])
        for e in {r["epoch"] for r in mine}:  # no block twice in a pass
            assert len({r["block"] for r in mine if r["epoch"] == e}) == sum(r["epoch"] == e for r in mine)
        docs = sorted((r["start"], r["doc_id"], r["size"]) for r in placed if r["source"] == s["source"])
        whose = [i for _, i, n in docs for _ in range(n)]
        for r in mine:
            taken.update(whose[r["block"] * 16 : r["block"] * 16 + r["words"]])
    got = {r["doc_id"]: r["taken"] for r in mixing.taken(df, block=16).collect()}
    assert got == {i: taken[i] for i, _, _ in rows}
    # shards are full but for the last
    sizes = Counter(r["shard"] for r in draws)
    assert set(sizes) == set(range(len(sizes))) and all(n == 10 for k, n in sizes.items() if k < len(sizes) - 1)


def test_permutations(spark):
    for n in (1, 2, 3, 5, 17, 64, 100, 1000, 12_345):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x"), F.col("id")).collect()
        assert sorted(r["x"] for r in got) == list(range(n))
        assert n < 100 or sum(r["x"] == r["id"] for r in got) < 10


def vectors():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] * rng.uniform(0.1, 9) + rng.normal(size=16) * 0.08).tolist()) for i in range(80)]
    rows += [(300, base[0].tolist()), (301, base[0].tolist()), (302, None), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [1.0, None] * 8), (306, []), (307, [1.0, 2.0]), (308, [2.0, 4.0]), (309, [float("inf")] + [0.0] * 15), (302, None), (7, base[9].tolist())]
    return rows


def test_embeddings(spark):
    rows = vectors()
    ok = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    g, n = Groups(), dict.fromkeys(range(len(rows)), 0)
    for i, x in ok.items():
        for j, y in ok.items():
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                n[i] += 1
                g.join(rows[i][0], rows[j][0])
    want = sorted((rows[k][0], n[k], g.find(rows[k][0]) if k in ok else rows[k][0]) for k in range(len(rows)))
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, unit string")
    for rows_ in (8000, 20, 3):
        got = embed_join.near_groups(df, piece_rows=rows_).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embed_join.near_groups(df.limit(0)).count() == 0


def test_what_a_task_of_the_join_receives(spark):
    rng = np.random.default_rng(3)
    for n in (400, 4000):
        # a third of all vectors in one place
        x = np.where(np.arange(n)[:, None] % 3 == 0, np.ones(32) + rng.normal(size=(n, 32)) * 1e-3, rng.normal(size=(n, 32)))
        reps = spark.createDataFrame([(i, v.astype(np.float32).tobytes()) for i, v in enumerate(x)], "id long, raw binary")
        tasks = embed_join.dealt(embed_join.spots(reps, 32, least=0.95, cell_rows=50), 50)
        assert tasks.groupBy("k", "cell", "i", "j").count().agg({"count": "max"}).first()[0] <= 2 * 50 * 1.6


def brute_removed(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s, o = b[k : k + length], float("inf") if i is None else i
            first[s] = min(first.get(s, o), o)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (float("inf") if i is None else i):
                m[k : k + length] = b"\1" * length
        kept = bytes(c for c, z in zip(b, m) if not z)
        spans = len(re.findall(rb"\x01+", bytes(m)))
        out.append((i, len(b), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    shared = [word(n) for n in (30, 48, 49, 50, 51, 70, 300, 3000)]
    rows = [(i, word(rnd.randrange(200)) + rnd.choice(shared) + word(rnd.randrange(60)) + rnd.choice(shared)) for i in range(60)]
    return rows + [(70, "z" * 500), (71, "z" * 90), (72, "z" * 49), (73, None), (74, ""), (3, rows[2][1]), (3, rows[2][1]), (None, rows[4][1]), (None, rows[4][1]), (80, rows[5][1] * 40)]


@pytest.mark.parametrize("length", [24, 50])
def test_passages(spark, length):
    rows = passages()
    for sizes in ({}, {"block_bytes": 2000, "bucket_rows": 3}):
        got = suffix_dedup.removal_digests(frame(spark, rows), length=length, **sizes).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_removed(rows, length)
    assert suffix_dedup.removal_digests(frame(spark, [])).count() == 0


def test_passages_leave_valid_texts(spark):
    rows = passages()
    df = frame(spark, rows)
    got = suffix_dedup.deduplicated(df)
    assert got.columns == df.columns and got.count() == len(rows)
    assert [r["text"] for r in got.where("doc_id = 73").collect()] == [None]
    removed = {i: n for i, n, r, s, h in brute_removed(rows, 50) if r == 0}
    by = {i: t for i, t in rows}
    assert all(r["text"] == by[r["doc_id"]] for r in got.collect() if r["doc_id"] in removed and r["doc_id"] != 3)


def test_cover():
    for v, d in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_revisits(spark):
    t = "timestamp'2024-01-01 00:00:0{}'"
    rec = lambda i, url, s, kind, etag=None, lm=None, h="map()": f"({i}, {url!r}, {t.format(s) if s is not None else 'null'}, {kind!r}, {etag or 'null'}, {lm or 'null'}, {h})"
    rows = [
        rec(1, "http://www.A.com/x/", 1, "response", "'\"1\"'", "'d'", "map('Content-Type', 'a', 'ETag', '\"1\"')"), rec(2, "https://a.com:443/x#f", 2, "response", "'\"2\"'", "'e'"),
        rec(3, "http://a.com/x?utm_source=q", 3, "revisit", "'W/\"2\"'", None, "map('Content-Type', 'b', 'Age', '5')"), rec(4, "http://a.com/x", 2, "revisit", "'\"1\"'", None, "map('Content-Length', '0', 'age', '9')"), rec(5, "http://a.com/x", 1, "revisit"),
        rec(6, "http://a.com/x", 4, "revisit", "'\"1\"'"), rec(7, "http://a.com/x", 4, "revisit", None, "'e'"), rec(8, "http://a.com/x", 4, "revisit"), rec(9, "http://b.com", 4, "revisit"), rec(10, "http://a.com/x", None, "revisit"), rec(11, "http://a.com/x", 4, "request"),
    ]
    df = spark.sql("select id record_id, url, ts, kind, etag, lm last_modified, cast(h as map<string,string>) headers, 'q' status from values " + ", ".join(rows) + " as v(id, url, ts, kind, etag, lm, h)")
    for slices in (128, 2):
        got = {r["record_id"]: (r["target_id"], r["status"], r["headers"]) for r in warc.resolve_revisits(df, slices=slices).collect()}
        assert got[3] == (2, "resolved", {"age": "5"})
        assert got[4] == (1, "resolved", {"content-type": "a", "etag": '"1"', "age": "9"})
        assert got[5][:2] == (None, "no_earlier") and got[6][:2] == (2, "mismatch") and got[7][:2] == (2, "resolved") and got[8][:2] == (2, "unverified") and got[9][1] == got[10][1] == "no_earlier" and 11 not in got
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_header_names_that_differ_in_case(spark):
    df = spark.sql("select map('Age', '1', 'AGE', null, 'Via', 'x', 'via', 'y') old, map('age', '2', 'Age', '3', 'Content-Length', '9') new")
    assert df.select(warc.merged_headers(df.old, df.new).alias("h")).first()["h"] == {"age": "3, 2", "via": "x, y"}
    assert df.select(warc.merged_headers(df.old, F.lit(None).cast("map<string,string>")).alias("h")).first()["h"] == {"age": "1", "via": "x, y"}
