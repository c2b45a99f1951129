"""Every registered query against its SQL twin on the smallest data."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from crossover.queries.fixtures import TABLES
from tests.conftest import SMALL

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    res = duck.execute(ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert got == want


def test_profile_of_every_column(spark, duck):
    got = {(r.table_name, r.column_name): r for r in QUERIES["column_profile_full"](spark, SMALL).collect()}
    tables = {t: spark.read.parquet(f"{SMALL}/{t}.parquet").columns for t in ("lineitem", "documents", "pages")}
    assert set(got) == {(t, c) for t, columns in tables.items() for c in columns}
    for (t, c), r in got.items():
        assert (r.row_count, r.exact_count) == duck.execute(f"select count(*), count(distinct {c}) from {t}").fetchone() and r.near, (t, c)
    assert got["documents", "text"].max_length == duck.execute("select max(length(text)) from documents").fetchone()[0]


def test_entry(spark):
    r = entry_point.entry(spark).collect()
    assert len(r) == 1 and r[0]["status"] == "issues_found"
