"""Every registered query with a DuckDB twin matches it on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as se
from tests.conftest import SF001
from tools.check_oracle import TABLES, rows_of
from tools.check_types import SPARK_TO_DUCK

ORACLE = se.oracle_sql()
QUERIES = se.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    cols = df.columns
    got = rows_of(cols, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    dtypes = {d[0]: str(d[1]) for d in res.description}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == dtypes
    assert got == rows_of(dcols, res.fetchall())


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0 and "spending_deviation_score" in df.columns
