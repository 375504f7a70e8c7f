"""Every registered query against its SQL in DuckDB, or for rows and a stable schema."""

import pytest

from assertlake.plans import registry
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same_rows(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_stay_in_the_engine(spark):
    """The flagship has no Python in its plan, prunes columns and pushes nothing through a single task but its few groups."""
    plan = registry.QUERIES["clean_pool_by_lang"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert "BroadcastHashJoin" in plan
