"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tidewake.plans import registry

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


def rows(names, values):
    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.5f}".replace("-0.00000", "0.00000")
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, int):
            return f"{float(x):.5f}" if abs(x) < 2**40 else str(x)
        if isinstance(x, (datetime.date, datetime.datetime)):
            return x.isoformat()
        return str(x)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, PATH)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert got == rows(names, cursor.fetchall())


#: Without rows on the smallest tables.
MAY_BE_EMPTY = {"c04_changepoints", "v05_walk_forward_evaluate", "v21_daily_signal"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    """Queries of models and random draws: their rows are whole, finite and the same when run again; their operators are tested with values."""
    query = registry.queries()[name]
    df = query(spark, PATH)
    first = df.collect()
    assert (first or name in MAY_BE_EMPTY) and len(set(df.columns)) == len(df.columns)
    assert all(v is None or not isinstance(v, float) or math.isfinite(v) for r in first for v in r)
    _, a = rows(df.columns, [tuple(r) for r in first])
    _, b = rows(df.columns, [tuple(r) for r in query(spark, PATH).collect()])
    assert a == b
