"""Every registered query that SQL can express gives the SQL's rows."""

import pytest

from scatterlake.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    same, first = compare(spark, SF_DIR, name, QUERIES[name], ORACLE_SQL[name])
    assert same, first


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_and_plans(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    from scatterlake.operators.clean import valid_rows
    from scatterlake.plans.options import check

    rows, *_ = valid_rows(df, check("l_extendedprice", "l_quantity"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_comment" not in plan and "l_orderkey" not in plan
