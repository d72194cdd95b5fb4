"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from quarry.plans.registry import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in NAMES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    rel = con.sql(ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert [rel.columns[i] for i in order] == columns
    assert rows == sorted(str([plain(r[i]) for i in order]) for r in rel.fetchall())
