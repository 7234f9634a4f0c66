import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as pipeline
from tidemark.llm import entries, simhash


def test_stages_chain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [k for k, _ in pipeline.STAGES] == ["language", "near_duplicates", "passages", "benchmark", "mixing"]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    small = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, small, sf).count() == 0


def test_run(spark, sf):
    rows = pipeline.run(spark, sf).collect()
    ids = [r["doc_id"] for r in rows]
    assert rows and len(set(ids)) == len(ids) and all(r["taken"] > 0 for r in rows)


def test_mixing_returns_each_row_once(spark, sf):
    """Rows without an id and rows that share one come back once each."""
    rows = [(None, "a " * 300, "en", "s", 600), (None, "b " * 300, "en", "s", 600), (7, "c " * 300, "en", "s", 600), (7, "d " * 300, "en", "s", 600), (7, "d " * 300, "en", "s", 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.mixing_stage(spark, docs, sf)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    got = out.collect()
    assert sorted(r["text"] for r in got) == sorted(r[1] for r in rows) and all(r["taken"] == 300 for r in got)


LONG = " ".join(f"word{i}" for i in range(60_000))
ODD = [
    (None, None, None, None, None), (None, "the one without an id and of some words " * 3, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, 0), (3, "123 !!", "en", "s", 7),
    (4, LONG, "en", "s", len(LONG)), (5, "twice the same row in here and no more of it " * 3, "en", None, 9), (5, "twice the same row in here and no more of it " * 3, "en", None, 9), (6, LONG + " end", "en", "s", 1), (7, "\t \n", "xx", "", None),
]


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, shared ids, and columns that bear names the stages use."""
    names = ("row", "block", "id", "rest", "lang_pred", "score", "size", "taken", "target", "doc", "g", "key")
    return spark.createDataFrame([(*r, *["own"] * len(names)) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))


def test_language_of_odd_rows(spark, sf):
    docs = odd(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    got = pipeline.language_stage(spark, docs, sf)
    assert got.columns == list(pipeline.COLUMNS)
    ids = [r["doc_id"] for r in got.collect()]
    assert not {1, 2, 3, 7} & set(ids) and len(got.collect()) > 0


def test_near_duplicates_of_odd_rows(spark, sf):
    got = pipeline.near_duplicate_stage(spark, odd(spark), sf)
    assert got.columns == list(pipeline.COLUMNS)
    # texts without words are one group, and the two long ones another
    assert sorted((r["doc_id"] or 0, r["text"] is None) for r in got.collect()) == sorted([(0, True), (0, False), (1, False), (3, False), (4, False), (5, False)])


def test_passages_of_odd_rows(spark, sf):
    got = pipeline.passage_stage(spark, odd(spark), sf)
    assert got.columns == list(pipeline.COLUMNS)
    rows = {}
    for r in got.collect():
        rows.setdefault(r["doc_id"], []).append(r["text"])
    assert len(rows[None]) == 2 and rows[1] == [""] and rows[2] == [None] and rows[3] == ["123 !!"] and rows[4] == [LONG] and rows[7] == ["\t \n"]
    assert rows[6] == [" end"] and len(rows[5]) == 2 and set(rows[5]) == {"twice the same row in here and no more of it " * 3}


def test_benchmark_of_odd_rows(spark, sf, tmp_path):
    spark.createDataFrame([(None, "word7 word8 word9 word10 word11 word12 word13 word14 word15 word16"), ("a", None), ("b", ""), ("c", "the same"), ("c", "the same")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.benchmark_stage(spark, odd(spark), str(tmp_path))
    assert got.columns == list(pipeline.COLUMNS)
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 0, 1, 2, 3, 7]


def test_mixing_of_odd_rows(spark, sf):
    got = pipeline.mixing_stage(spark, odd(spark), sf)
    assert got.columns == [*pipeline.COLUMNS, "size", "source_size", "target", "taken"]
    rows = got.collect()
    words = sum(len((t or "").split()) for _, t, *_ in ODD)
    assert sum(r["taken"] for r in rows) == words  # two sources: their targets share all words
    assert {r["doc_id"] for r in rows} <= {None, 3, 4, 5, 6} and all(0 < r["taken"] <= 3 * r["size"] for r in rows)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_revisits_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(entries.ORACLE_SQL["op2_warc_revisits"])
    names = [c[0] for c in want.description]
    got = entries.QUERIES["op2_warc_revisits"](spark, sf).select(*names)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_near_duplicates_by_fingerprint_and_by_similarity(spark, sf):
    """All pairs, by brute force: links within three bits of SimHash and links of similarity .8, of which each kind has pairs of its own."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(12):
        line = " ".join(word() for _ in range(9)) + " "
        rows += [(10 * k + j, line * 60 + " ".join(word() for _ in range(12))) for j in (0, 5, 7)]  # a line repeated, other words after it
        text = [word() for _ in range(9)]
        rows += [(10 * k + 1, " ".join(text)), (10 * k + 2, " ".join(text[:8]))]
        text = [word() for _ in range(300)]
        rows += [(10 * k + 3, " ".join(text)), (10 * k + 4, " ".join(text[:297])), (10 * k + 6, " ".join(word() for _ in range(80)))]
    rows += [(k + 1000, t) for k, t in rows[5:9]] + [(2000, None), (2001, ""), (2002, " \t")]
    fp, sets = {i: simhash.fingerprint(t) for i, t in rows}, {i: simhash.shingle_hashes(t, 5) for i, t in rows}
    ids, kinds = sorted(fp), set()
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            kind = ((fp[i] ^ fp[j]).bit_count() <= 3, simhash.similarity(sets[i], sets[j]) >= 0.8)
            kinds.add(kind)
            if any(kind) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = {n: lo if r == hi else r for n, r in root.items()}
    assert len(kinds) == 4
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicate_stage(spark, docs, sf)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root.values()))


def test_near_duplicates_leave_no_link_of_op5(spark, sf):
    """No two documents that the stage keeps are in one component of op5."""
    kept = pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id")
    groups = entries.QUERIES["op5_simhash"](spark, sf).join(kept, "doc_id")
    assert groups.count() == kept.count() > 0 and groups.groupBy("component_id").count().where("count > 1").isEmpty()
