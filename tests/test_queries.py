"""Every registered query of the feature library against its SQL, on whole small tables."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__
from ledgerline.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages labels".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}".replace("-0", "0") if abs(v) < 1e-12 else f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == want and got


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
