import pytest

from libroflow.plans import extraction, reference, sources, training
from tests.oracle import DATA, connect, differences


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(reference.ORACLES))
def test_reference_query(spark, con, name, tmp_path):
    df = reference.QUERIES[name](spark, DATA)
    assert differences(con, df, reference.ORACLES[name], str(tmp_path / name)) == (True, 0, 0)


@pytest.mark.parametrize("name", sorted(training.ORACLES))
def test_problem_query(spark, con, name, tmp_path):
    assert differences(con, training.QUERIES[name](spark, DATA), training.ORACLES[name], str(tmp_path / name)) == (True, 0, 0)


@pytest.mark.parametrize("name", sorted(extraction.ORACLES))
def test_extraction_query(spark, con, name, tmp_path):
    assert differences(con, extraction.QUERIES[name](spark, DATA), extraction.ORACLES[name], str(tmp_path / name)) == (True, 0, 0)


@pytest.mark.parametrize("name", sorted(sources.ORACLES))
def test_source_query(spark, con, name, tmp_path):
    assert differences(con, sources.QUERIES[name](spark, DATA), sources.ORACLES[name], str(tmp_path / name)) == (True, 0, 0)


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.ORACLES)) + sorted(set(training.QUERIES) - set(training.ORACLES)))
def test_query_runs(spark, name):
    q = (reference.QUERIES | training.QUERIES)[name]
    assert q(spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
