"""Every registered query against its SQL in DuckDB, on small tables."""

import decimal
import math
from pathlib import Path

import pytest

from shelfmark.plans.registry import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF / t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9) if math.isfinite(v) else str(v)
    return v if isinstance(v, (int, float)) else str(v)


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(SF))
    rows = sorted(([plain(r[c]) for c in sorted(found.columns)] for r in found.collect()), key=str)
    if name not in ORACLE_SQL:
        return
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(([plain(r[i]) for i in order] for r in want.fetchall()), key=str)
