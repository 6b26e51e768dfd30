"""A spread of registered queries against DuckDB; tools/check_oracle.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canon

NAMES = ("naive_rates", "interference", "clean_laps", "rolling_folds", "ladder", "split_conformal", "loeo_intervals", "signed_rank", "curve_shapes", "stored_laps", "manifest_of_files", "life_labels", "derived_cache",
         "recommendations", "stop_windows", "match_events", "resolve_events", "live_stream_agrees", "trust_regimes", "result_sentences", "bm25_top", "lexical_ranks",
         "split_half", "decision_outcomes", "decomposition", "competitive_life", "lap_energy", "health_index", "bm25", "number_check")


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert all(isinstance(s, str) and s for s in o.values())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, data, name):
    df = entry.queries()[name](spark, data)
    rows = sorted(tuple(canon(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())
