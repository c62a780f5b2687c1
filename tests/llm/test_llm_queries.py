import pathlib

import pytest

from quire.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables aren't here")


@pytest.mark.parametrize("name", QUERIES)
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
