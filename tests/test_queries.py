"""Registered spatial queries against their SQL on the smallest tables."""

import duckdb
import pytest

from cellweave.plans import ORACLE, QUERIES
from cellweave.sources.views import TABLES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tiny}/{table}.parquet'")
    want = db.sql(ORACLE[name])
    got = QUERIES[name](spark, tiny)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert tidy(tuple(r) for r in got.select(names).collect()) == tidy(db.sql(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({ORACLE[name]})").fetchall())
