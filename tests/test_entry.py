import duckdb
import pytest

import __spark_entry__ as contract
from funnelspark.plans.registry import REGISTRY
from tests.conftest import SF

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
SAMPLE = (
    "fct_funnel", "fct_orders", "metric_product", "metric_retention", "repeat_purchase_rate", "rfm_scores", "last_non_direct",
    "diagnosis_weeks", "suppression", "classify_change", "check_relationships", "ewma_anomaly",
    "drill_tree", "metric_stored", "cohort_retention_orders", "item_view_lines",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_entry_gives_rows(spark):
    result = contract.entry(spark)
    assert result.columns == ["week", "channel_group", "sessions", "purchasing_sessions", "session_conversion_rate"]
    assert result.count() > 0


def test_every_oracle_has_a_query_and_every_query_of_the_registry_an_oracle():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(REGISTRY) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_oracle(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(repr([r[i] for i in order]) for r in result.fetchall())


@pytest.mark.parametrize("name", ("fct_funnel", "fct_orders", "metric_product", "suppression", "attribution_models", "similar_findings"))
def test_plans_hold_no_cartesian_product(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
