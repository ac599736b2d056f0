"""Every registered query of the engine against its SQL in DuckDB."""

import math

import pytest

import __spark_entry__ as entry
from casegraph.plans import catalogue

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return repr(round(float(x), 6))
        return str(x).removesuffix(" 00:00:00")

    return sorted(tuple(one(r[c]) for c in sorted(r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    got = [r.asDict() for r in catalogue.queries()[name](spark, sf).collect()]
    cursor = duck.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in cursor.description]
    want = [dict(zip(cols, r, strict=True)) for r in cursor.fetchall()]
    assert plain(got) == plain(want)


def test_entry_and_names(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
