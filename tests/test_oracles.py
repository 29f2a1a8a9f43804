"""Registered queries against their DuckDB oracle on sf0.001 (a fast
subset of what the driver checks at sf0.01; tools/check_oracle.py runs all)."""

import duckdb
import pytest

import __spark_entry__ as E
from revlens.sources.tables import TABLES
from tools.check_oracle import rows

from .conftest import SF_SMALL

FAST = ["category_metrics", "author_metrics", "flag_duplicate_ids", "flag_duplicate_rows", "dqa_flags",
        "dqa_report", "clean_summary", "text_features", "readability", "bigrams", "parse_dates",
        "column_profile", "counts_by_category", "lorenz_gini", "sample_exact", "stratified_sample",
        "top_apps_per_category", "tfidf_top_terms", "detect_language", "staged_completeness"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    c1, r1 = rows(sp)
    c2, r2 = rows(dd)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "category"


def test_every_query_has_callable():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 100
