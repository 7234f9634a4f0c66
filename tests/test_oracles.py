"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from tidemark.plans.view_queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: "" if x is None or x != x else f"{x + 0.0:.6f}" if isinstance(x, float) else str(x)
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


SOME = ("bars_daily", "zscore_last", "ts_rank", "rank_cs", "alpha_combo", "frm_composite", "overlap", "consensus", "hit_rate", "ar1_by_factor", "cot_zscore", "gex", "calendar_events", "clean_text", "archive_last_wins", "streaming_bars", "keltner", "signal_history", "signals_all", "overlap_ranked", "feed_new_items", "archive_rerun", "ema_columns", "extract_links", "page_classify", "price_scan", "ticker_news")


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), [c[0] for c in want.description])


def test_queries_with_sql_outnumber_others():
    assert set(QUERIES) == set(ORACLE_SQL)
