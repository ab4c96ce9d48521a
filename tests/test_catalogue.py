import pytest

from tests.oracle import connect, same_rows
from tidewell.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_no_python_in_plans(spark):
    for name, f in QUERIES.items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "MapInArrow" not in plan, name
