import pytest
from pyspark.sql import functions as F

from funnelspark.operators.metrics import DIMENSIONS, ITEM_DIMS, METRICS, Filter, SemanticError, metric_query
from tests.conftest import rows


def test_registry_is_complete_and_resolves():
    assert len(METRICS) == 49 and len(DIMENSIONS) == 19
    assert all(d in DIMENSIONS for m in METRICS.values() for d in m.dims)
    assert all(set(ITEM_DIMS) <= m.dims for m in METRICS.values() if m.grain == "fct_order_items")


@pytest.mark.parametrize("metrics, dims, filters, message", [
    ([], [], [], "at least one"),
    (["profit"], [], [], "not a governed metric"),
    (["sessions"], ["planet"], [], "not a governed dimension"),
    (["cac_proxy"], ["browser"], [], "cannot be grouped"),
    (["sessions", "orders"], [], [], "different grains"),
    (["sessions"], [], [{"dimension": "planet", "op": "=", "value": 1}], "not a governed dimension"),
    (["sessions"], [], [{"dimension": "country", "op": "LIKE", "value": "x"}], "unsupported filter op"),
])
def test_ungoverned_requests_are_refused(marts, metrics, dims, filters, message):
    with pytest.raises(SemanticError, match=message):
        metric_query(marts, metrics, dims, filters)


def test_filter_dimension_need_not_be_groupable(marts):
    got = rows(metric_query(marts, ["cac_proxy", "paid_sessions"], [], [Filter("browser", "=", "Chrome")]))
    expected = marts.funnel.filter("browser = 'Chrome' AND channel_group IN ('Paid Search', 'Paid Social', 'Display')").count()
    assert got[0]["paid_sessions"] == expected


def test_two_level_counts_equal_plain_distinct_counts(marts):
    metrics = ["users", "new_users", "returning_users", "purchasing_users", "sessions", "revenue"]
    fast = metric_query(marts, metrics, ["week", "channel_group"])
    slow = metric_query(marts, metrics, ["week", "channel_group"], trust_grain=False)
    plain = marts.funnel.groupBy(F.trunc("event_date", "week").alias("week"), "channel_group").agg(
        F.count_distinct("user_pseudo_id").alias("users"),
        F.count_distinct(F.when(F.col("is_new_user"), F.col("user_pseudo_id"))).alias("new_users"),
        F.count_distinct(F.when(~F.col("is_new_user"), F.col("user_pseudo_id"))).alias("returning_users"),
        F.count_distinct(F.when(F.col("reached_purchase"), F.col("user_pseudo_id"))).alias("purchasing_users"),
        F.count_distinct("session_key").alias("sessions"),
        F.sum(F.col("session_revenue").cast("decimal(18,2)")).cast("double").alias("revenue"))
    assert fast.exceptAll(plain).count() == 0 and slow.exceptAll(plain).count() == 0


def test_no_copy_of_rows_per_distinct_count(marts):
    plan = metric_query(marts, ["users", "new_users", "purchasing_users"], ["channel_group"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_shares_add_up_to_one(marts):
    shares = rows(metric_query(marts, ["traffic_share"], ["channel_group", "device_category"]))
    assert sum(r["traffic_share"] for r in shares) == pytest.approx(1.0)


def test_zero_denominator_is_null(marts):
    got = rows(metric_query(marts, ["sessions", "session_conversion_rate"], [], [Filter("country", "=", "NOWHERE")]))
    assert got == [{"sessions": 0, "session_conversion_rate": None}]


def test_filters_on_other_tables_are_semi_joins_ahead_of_the_aggregation(marts):
    request = metric_query(marts, ["orders"], ["week"], [Filter("browser", "=", "Chrome"), Filter("region", "=", "ASIA"), Filter("item_brand", "!=", "x")])
    plan = request._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2 and "Cartesian" not in plan
    chrome = marts.sessions.filter("browser = 'Chrome'").select("session_key")
    got = metric_query(marts, ["orders"], [], [Filter("browser", "=", "Chrome")]).first()["orders"]
    assert got == marts.orders.join(chrome, "session_key", "left_semi").count() > 0
    assert metric_query(marts, ["orders"], [], [Filter("browser", "=", "none")]).first()["orders"] == 0


def test_a_filter_needs_its_bridge(marts):
    with pytest.raises(SemanticError, match="without the table fct_sessions"):
        metric_query({"fct_orders": marts["fct_orders"]}, ["orders"], [], [Filter("browser", "=", "Chrome")])
