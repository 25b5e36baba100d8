"""Every registered query with SQL against DuckDB on the small tables; the others run and have rows."""

import math
import os
from datetime import UTC

import duckdb
import pytest

from siftloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return str(v.astimezone(UTC).replace(tzinfo=None))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    cursor = db.execute(registry.SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
