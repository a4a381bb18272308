"""Every registered query with SQL gives the rows that DuckDB gives."""

from collections import Counter

import duckdb
import pytest

from tallyframe.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = db.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in got.fetchall())
