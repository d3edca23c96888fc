"""Registered queries of the subpackage against their DuckDB SQL, and what their plans hold."""

from collections import Counter
from pathlib import Path

import pytest

from tarn.llm import decontaminate, quality, queries

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, D)
    want = duck.sql(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_query(spark, name):
    assert queries.queries()[name](spark, D).count() >= 200


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_made_of_statistics_made_once(spark):
    """The optimizer must not push the filter on the score below the statistics, nor write those into every rule."""
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert len(model.rules) > 5
    once, plan = _optimized(quality.statistics(docs, "doc_id")), _optimized(quality.accepted(docs, model))
    for part in ("regexp_extract_all", "regexp_count", "array_distinct"):
        assert plan.count(part) <= once.count(part)


def test_places_are_found_once(spark):
    """Nor may it compute the list of a document's hits again where that is read."""
    docs, items = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = _optimized(decontaminate.overlaps(docs.select("doc_id", "text"), items.select("item_id", "text")))
    assert plan.count("spark_partition_id") <= 1 and plan.count("getbit") <= 1 + len(decontaminate.MASKS)
