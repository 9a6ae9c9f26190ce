"""All queries of the engine that have SQL against it, on the smallest tables; tests/compare.py does the same on others."""

import pytest
from compare import compare, duck
from conftest import DATA

from orrery.plans import catalog


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query(spark, con, name):
    said = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], DATA)
    assert said.startswith("ok"), said


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cluster_queries_see_whole_tables(spark, monkeypatch):
    from pyspark.sql import functions as F

    from orrery.plans import graphs
    from orrery.plans import tables as t

    q = catalog.QUERIES
    assert q["ITR01_smooth"](spark, DATA).count() == t.points(spark, DATA).count()
    rows = t.table(spark, DATA, "lineitem")
    assert q["CLU03_largest_region"](spark, DATA).count() == rows.filter("l_discount < 0.04").select("l_suppkey").distinct().count()
    assert q["GRA10_tracks"](spark, DATA).count() > 0
    monkeypatch.setattr(graphs.g, "establish_tracks", lambda m, *_: m.withColumn("track_id", F.lit(0)))
    whole = rows.selectExpr("l_suppkey % 20 AS i1", "l_partkey % 400 AS f1", "l_orderkey % 20 AS i2", "l_partkey * 3 % 400 AS f2").filter("i1 <> i2").distinct().count()
    assert [x.n for x in q["GRA10_tracks"](spark, DATA).collect()] == [whole]
