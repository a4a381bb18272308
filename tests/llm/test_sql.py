"""The operators that SQL can express against their SQL."""

from collections import Counter

import duckdb
import pytest

from tallyframe.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, df = db.execute(Q.oracle_sql()[name]), Q.queries()[name](spark, SF)
    names, cols = [d[0] for d in got.description], sorted(df.columns)
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in got.fetchall())
