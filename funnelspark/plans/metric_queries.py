"""Governed metric requests; together they ask for all 49 metrics and 19 dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from funnelspark.operators.metrics import metric_query
from funnelspark.plans.common import query, report
from funnelspark.plans.marts import Marts, build_marts
from funnelspark.session import scratch_path

STEPS = (
    "view_item_sessions", "add_to_cart_sessions", "begin_checkout_sessions", "add_shipping_info_sessions",
    "add_payment_info_sessions", "purchasing_sessions",
)
FILTERS = (
    {"dimension": "day", "op": "BETWEEN", "value": ["2024-01-03", "2024-01-27"]},
    {"dimension": "channel_group", "op": "NOT IN", "value": ["Direct", "Other"]},
    {"dimension": "device_category", "op": "IN", "value": ["mobile", "desktop"]},
    {"dimension": "country", "op": "!=", "value": "NATION_3"},
    {"dimension": "is_new_user", "op": "=", "value": False},
    {"dimension": "week", "op": ">=", "value": "2024-01-01"},
    {"dimension": "week", "op": "<", "value": "2024-01-29"},
    {"dimension": "month", "op": "<=", "value": "2024-01-01"},
    {"dimension": "day", "op": ">", "value": "2024-01-02"},
)


@query
def metric_traffic(m: Marts) -> DataFrame:
    return report(metric_query(m, ["sessions", "users", "new_users", "returning_users"], ["week", "channel_group"]))


@query
def metric_funnel(m: Marts) -> DataFrame:
    rates = ["view_to_cart_rate", "cart_to_checkout_rate", "checkout_to_purchase_rate"]
    return report(metric_query(m, [*STEPS, *rates], ["device_category", "operating_system", "browser"]))


@query
def metric_conversion(m: Marts) -> DataFrame:
    metrics = ["session_conversion_rate", "user_conversion_rate", "purchasing_users", "purchasing_sessions"]
    return report(metric_query(m, metrics, ["day", "is_new_user"]))


@query
def metric_stored(m: Marts) -> DataFrame:
    """``metric_conversion`` on marts that were built and stored first."""
    stored = build_marts(m, scratch_path(m.spark, "marts"), ("fct_sessions", "fct_funnel", "fct_orders"))
    metrics = ["session_conversion_rate", "user_conversion_rate", "purchasing_users", "purchasing_sessions"]
    return report(metric_query(stored, metrics, ["day", "is_new_user"]))


@query
def metric_channel_conversion(m: Marts) -> DataFrame:
    return report(metric_query(m, ["channel_conversion_rate", "sessions"], ["channel_group", "source", "medium"]))


@query
def metric_session_revenue(m: Marts) -> DataFrame:
    return report(metric_query(m, ["revenue", "revenue_per_user", "revenue_per_session"], ["month", "campaign"]))


@query
def metric_session_number(m: Marts) -> DataFrame:
    return report(metric_query(m, ["sessions", "revenue", "users"], ["quarter", "session_number_bucket", "region"]))


@query
def metric_engagement(m: Marts) -> DataFrame:
    return report(metric_query(m, ["engaged_sessions", "engagement_rate"], ["landing_page", "week"]))


@query
def metric_revenue(m: Marts) -> DataFrame:
    metrics = ["orders", "gross_revenue", "net_revenue", "aov", "channel_revenue"]
    return report(metric_query(m, metrics, ["week", "channel_group"]))


@query
def metric_retention(m: Marts) -> DataFrame:
    days = (1, 7, 30)
    metrics = ["cohort_size", *[f"retained_users_d{d}" for d in days], *[f"day_{d}_retention" for d in days]]
    return report(metric_query(m, metrics, ["week", "device_category"]))


@query
def metric_product(m: Marts) -> DataFrame:
    m.share_sessions()
    metrics = [
        "product_revenue", "product_conversion_rate", "product_attach_rate", "item_views", "item_purchases",
        "orders_with_item",
    ]
    return report(metric_query(m, metrics, ["week", "item_category"]))


@query
def metric_product_view(m: Marts) -> DataFrame:
    m.share_sessions()
    metrics = ["product_view_rate", "item_view_sessions"]
    return report(metric_query(m, metrics, ["channel_group", "item_brand"]))


@query
def attach_rate(m: Marts) -> DataFrame:
    m.share_sessions()
    return report(metric_query(m, ["product_attach_rate", "orders_with_item"], ["item_name"]))


@query
def metric_acquisition(m: Marts) -> DataFrame:
    return report(metric_query(m, ["paid_sessions", "new_purchasers"], ["week", "region"]))


@query
def cac_proxy(m: Marts) -> DataFrame:
    return report(metric_query(m, ["cac_proxy", "paid_sessions", "new_purchasers"], ["week", "device_category"]))


@query
def repeat_purchase_rate(m: Marts) -> DataFrame:
    m.share_orders()
    metrics = ["repeat_purchase_rate", "purchasers", "repeat_purchasers", "orders"]
    return report(metric_query(m, metrics, ["device_category", "country"]))


@query
def traffic_share(m: Marts) -> DataFrame:
    return report(metric_query(m, ["traffic_share", "sessions"], ["channel_group"]))


@query
def metric_filtered(m: Marts) -> DataFrame:
    metrics = ["sessions", "session_conversion_rate", "revenue", "users"]
    return report(metric_query(m, metrics, ["week", "device_category"], FILTERS))


@query
def metric_total(m: Marts) -> DataFrame:
    metrics = ["sessions", "users", "purchasing_sessions", "revenue", "session_conversion_rate", "traffic_share"]
    return report(metric_query(m, metrics))


@query
def metric_total_orders(m: Marts) -> DataFrame:
    m.share_orders()
    return report(metric_query(m, ["orders", "net_revenue", "aov", "repeat_purchase_rate", "purchasers"]))


@query
def metric_total_products(m: Marts) -> DataFrame:
    m.share_sessions()
    item_filter = [{"dimension": "item_category", "op": "IN", "value": ["ECONOMY", "SMALL"]}]
    return report(metric_query(m, ["product_attach_rate", "item_views", "product_revenue"], (), item_filter))


# ── filters on dimensions that a metric's table lacks ────────────────────────

@query
def orders_by_browser(m: Marts) -> DataFrame:
    m.share_sessions().share_orders()
    filters = [{"dimension": "browser", "op": "IN", "value": ["Chrome", "Edge"]}, {"dimension": "region", "op": "!=", "value": "ASIA"}]
    return report(metric_query(m, ["orders", "gross_revenue", "aov", "repeat_purchase_rate"], ["channel_group"], filters))


@query
def orders_with_brand(m: Marts) -> DataFrame:
    m.share_sessions().share_orders()
    filters = [{"dimension": "item_brand", "op": "IN", "value": ["Brand#1", "Brand#2", "Brand#3"]}, {"dimension": "item_category", "op": "!=", "value": "SMALL"}]
    return report(metric_query(m, ["orders", "net_revenue"], ["week"], filters))


@query
def product_revenue_by_source(m: Marts) -> DataFrame:
    m.share_sessions()
    filters = [{"dimension": "source", "op": "NOT IN", "value": ["google", "(direct)"]}, {"dimension": "day", "op": ">=", "value": "2024-01-08"}]
    return report(metric_query(m, ["product_revenue", "item_views", "item_purchases"], ["item_category"], filters))


@query
def cohort_size_by_landing_page(m: Marts) -> DataFrame:
    m.share_sessions()
    filters = [{"dimension": "landing_page", "op": "<", "value": "/p/5"}, {"dimension": "country", "op": "!=", "value": "NATION_3"}]
    return report(metric_query(m, ["cohort_size", "retained_users_d1", "retained_users_d7", "day_7_retention"], ["week", "device_category"], filters))


@query
def sessions_by_item(m: Marts) -> DataFrame:
    m.share_sessions()
    filters = [{"dimension": "item_category", "op": "=", "value": "ECONOMY"}, {"dimension": "browser", "op": "=", "value": "Chrome"}]
    return report(metric_query(m, ["sessions", "users", "session_conversion_rate"], ["channel_group"], filters))
