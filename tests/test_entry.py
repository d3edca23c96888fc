"""Registered queries against their own SQL in DuckDB, on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__
from tarn import queries

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, D)
    want = duck.sql(queries.oracle_sql()[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), [d[0] for d in want.description])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_query(spark, name):
    assert queries.queries()[name](spark, D).count() > 0


def test_all_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
