"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as driver
from compare import compare, duck
from txnrisk.plans.oracles import ORACLES
from txnrisk.plans.queries import QUERIES

WITHOUT_SQL = {"feature_importance", "model_comparison", "wide_model_comparison", "trained_scores"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_only_fitted_models_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    """The rows agree, and the plan holds no Python and no product of two inputs."""
    df = driver.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("PythonUDF", "ArrowEval", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, plan
    assert compare(df, con, driver.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
