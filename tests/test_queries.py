import pytest
from conftest import same_as_oracle

from palisade.oracles import ORACLES
from palisade.queries import QUERIES

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(name, spark, oracle, data_dir):
    same_as_oracle(spark, oracle, QUERIES[name], ORACLES[name], data_dir)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(name, spark, data_dir):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
