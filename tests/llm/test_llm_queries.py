import pytest

from libroflow.llm import queries
from tests.oracle import DATA, connect, differences


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name, tmp_path):
    assert differences(connect(), queries.QUERIES[name](spark, DATA), queries.ORACLES[name], str(tmp_path / name)) == (True, 0, 0)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.count()
    assert rows > 0 and df.distinct().count() == rows
