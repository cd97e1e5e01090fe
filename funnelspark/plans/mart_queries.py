"""Queries over staging, session, order, item and cohort tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import channel_group, event_param
from funnelspark.functions.numeric import money_sum
from funnelspark.operators import active_days, attribution, cohorts, daily, dims, orders, rfm, sessions, staging
from funnelspark.plans.common import query, report
from funnelspark.plans.marts import Marts
from funnelspark.session import scratch_path
from funnelspark.sources.daytable import DayTable
from funnelspark.sources.eventstore import EventStore

RFM_AS_OF = dt.date(2001, 1, 1)
FUNNEL_DIMS = ("channel_group", "device_category", "country", "operating_system")


@query
def stg_events(m: Marts) -> DataFrame:
    return report(m.stg.drop("user_id", "device_language", "city"))


@query
def stg_event_params(m: Marts) -> DataFrame:
    params = staging.stg_event_params(m.raw)
    return report(params, "event_date", "event_name", "event_timestamp", "user_pseudo_id", "param_key", "string_value", "int_value", "value_string")


@query
def event_param_lookup(m: Marts) -> DataFrame:
    found = m.raw.select(
        "event_name",
        event_param("ga_session_id", "int").alias("sid"),
        event_param("page_location").alias("page"),
        event_param("campaign").alias("campaign"),
        event_param("engagement_time_msec", "int").alias("msec"),
        event_param("source", "int").alias("wrong_slot"),
        event_param("no_such_key").alias("absent"),
    )
    return found.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("events"), F.count("sid").alias("with_session"), F.count("page").alias("with_page"),
        F.max("page").alias("last_page"), F.count("campaign").alias("with_campaign"), F.sum("msec").alias("msec"),
        F.count("wrong_slot").alias("wrong_slot"), F.count("absent").alias("absent"),
    )


@query
def session_keys(m: Marts) -> DataFrame:
    return m.stg.groupBy("user_pseudo_id", "ga_session_id", "session_key").agg(F.count(F.lit(1)).alias("events"))


@query
def channel_group_counts(m: Marts) -> DataFrame:
    channel = channel_group("event_source", "event_medium", "gclid").alias("channel")
    return m.stg.groupBy("event_source", "event_medium", channel).agg(F.count(F.lit(1)).alias("events"))


@query
def sessionized(m: Marts) -> DataFrame:
    return report(sessions.int_sessionized(m.stg).drop("city"))


@query
def landing_page(m: Marts) -> DataFrame:
    return sessions.int_sessionized(m.stg).groupBy("landing_page").agg(F.count(F.lit(1)).alias("sessions"))


@query
def funnel_steps(m: Marts) -> DataFrame:
    return report(sessions.int_funnel_steps(m.stg))


@query
def session_revenue_dedup(m: Marts) -> DataFrame:
    steps = sessions.int_funnel_steps(m.stg).filter("session_revenue > 0")
    return report(steps, "session_key", "transaction_id", "session_revenue")


@query
def fct_funnel(m: Marts) -> DataFrame:
    return report(m.funnel)


@query
def fct_funnel_join(m: Marts) -> DataFrame:
    return report(sessions.fct_funnel(sessions.int_sessionized(m.stg), sessions.int_funnel_steps(m.stg)))


@query
def fct_sessions(m: Marts) -> DataFrame:
    return report(m.sessions)


@query
def fct_daily_funnel(m: Marts) -> DataFrame:
    return report(m.daily)


@query
def fct_daily_funnel_distinct(m: Marts) -> DataFrame:
    return report(daily.fct_daily_funnel(m.funnel, distinct=True))


@query
def fct_orders(m: Marts) -> DataFrame:
    return report(m.orders)


@query
def orders_in_window(m: Marts) -> DataFrame:
    window = orders.fct_orders(m.raw, m.funnel, dt.date(2024, 1, 8), dt.date(2024, 1, 21))
    return report(window.groupBy("event_date", "channel_group").agg(
        F.count(F.lit(1)).alias("orders"), money_sum("gross_revenue").alias("gross_revenue"),
        money_sum("net_revenue").alias("net_revenue"), money_sum("tax_value_in_usd").alias("tax"),
    ))


@query
def dim_channels(m: Marts) -> DataFrame:
    counts = m.funnel.groupBy("channel_group").agg(F.count(F.lit(1)).alias("sessions"))
    return report(dims.dim_channels(m.spark).join(counts, "channel_group", "left"))


@query
def dim_date(m: Marts) -> DataFrame:
    bounds = m.funnel.agg(F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))
    return report(dims.date_spine(bounds))


@query
def weekly_funnel(m: Marts) -> DataFrame:
    return report(daily.weekly_funnel(m.funnel))


@query
def weekly_from_daily(m: Marts) -> DataFrame:
    return report(daily.weekly_from_daily(m.daily))


@query
def funnel_by_dim(m: Marts) -> DataFrame:
    return report(daily.funnel_by_dim(m.funnel, FUNNEL_DIMS))


@query
def base_segments(m: Marts) -> DataFrame:
    return daily.base_segments(daily.weekly_funnel(m.funnel))


@query
def fct_order_items(m: Marts) -> DataFrame:
    return report(m.order_items)


@query
def item_view_lines(m: Marts) -> DataFrame:
    return report(m.view_lines)


@query
def buyer_order_counts(m: Marts) -> DataFrame:
    m.share_orders()
    return report(m.buyer_orders, "order_key", "buyer_user_id", "user_order_count")


@query
def dim_users(m: Marts) -> DataFrame:
    return report(dims.dim_users(m.sessions, dims.dim_channels(m.spark)))


@query
def dim_items(m: Marts) -> DataFrame:
    return report(dims.dim_items(dims.item_observations(m.raw_with_items)))


def priced_parts(m: Marts) -> DataFrame:
    """Unit price of every sold part on its ship date."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    unit_cents = F.floor(cents / F.col("l_quantity").cast("long"))
    lines = m.table("lineitem").select(
        F.col("l_partkey"), F.col("l_shipdate").cast("timestamp").alias("observed_ts"),
        (unit_cents / 100).alias("price_in_usd"),
    )
    parts = m.table("part").select("p_partkey", "p_name", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("item_key"), "observed_ts", F.col("p_name").alias("item_name"),
        F.col("p_type").alias("item_category"), "price_in_usd",
    )


@query
def items_scd2(m: Marts) -> DataFrame:
    return report(dims.snap_items(priced_parts(m)))


@query
def fct_cohorts(m: Marts) -> DataFrame:
    return report(m.cohorts)


@query
def cohort_retention(m: Marts) -> DataFrame:
    return report(cohorts.cohort_retention(m.sessions, periods=5, grain="week"))


@query
def cohort_retention_orders(m: Marts) -> DataFrame:
    """Monthly retention of the buyers of years of orders: a matrix of many cohorts."""
    visits = m.table("orders").select(F.col("o_custkey").alias("user_pseudo_id"), F.to_date("o_orderdate").alias("event_date"))
    return report(cohorts.cohort_retention(visits, periods=5, grain="month"))


@query
def retention_curve(m: Marts) -> DataFrame:
    m.share_sessions()
    return report(cohorts.retention_curve(m.sessions))


# ── sessions from bucketed events, cohorts from bitmaps of active days ───────


def event_store(m: Marts, buckets: int = 16) -> EventStore:
    path = scratch_path(m.spark, "events")
    return EventStore(m.spark, path.rpartition("/")[2].replace("-", "_"), path).write(m.stg, buckets)


@query
def bucketed_funnel(m: Marts) -> DataFrame:
    return report(event_store(m).by_user(lambda stg: sessions.funnel_facts(sessions.session_rollup(stg))))


@query
def bucketed_sessions(m: Marts) -> DataFrame:
    return report(event_store(m).by_user(lambda stg: sessions.fct_sessions(sessions.session_rollup(stg))))


@query
def bucketed_cohorts(m: Marts) -> DataFrame:
    """Users are whole in their bucket, so each bucket goes from events to users in one task; cohorts are exchanged alone."""
    users = event_store(m).by_user(lambda stg: cohorts.user_days(sessions.fct_sessions(sessions.session_rollup(stg))))
    return report(cohorts.cohorts_of(users))


def bitmaps_day_by_day(m: Marts) -> DayTable:
    """Bitmaps of all sessions but those of the last two days, then those days, one after the other."""
    m.share_sessions()
    table = DayTable(m.spark, scratch_path(m.spark, "active-days"), active_days.STRETCH)
    last = m.sessions.agg(F.max("event_date")).first()[0]
    before = last - dt.timedelta(days=2)
    active_days.add_sessions(table, m.sessions.filter(F.col("event_date") <= F.lit(before)))
    for back in (1, 0):
        active_days.add_sessions(table, m.sessions.filter(F.col("event_date") == F.lit(last - dt.timedelta(days=back))))
    return table


@query
def bitmap_cohorts(m: Marts) -> DataFrame:
    return report(cohorts.cohorts_of(active_days.users(bitmaps_day_by_day(m).read())))


@query
def bitmap_retention_curve(m: Marts) -> DataFrame:
    return report(cohorts.retention_curve_of(active_days.users(bitmaps_day_by_day(m).read())))


@query
def bitmap_cohort_retention(m: Marts) -> DataFrame:
    users = active_days.users(bitmaps_day_by_day(m).read())
    return report(cohorts.cohort_retention_of(users, users.agg(F.max(F.element_at("days", -1))).scalar(), periods=5, grain="week"))


@query
def rfm_scores(m: Marts) -> DataFrame:
    totals = rfm.buyer_totals(m.table("orders"), RFM_AS_OF, "o_custkey", "o_orderdate", "o_totalprice")
    return report(rfm.rfm_segment(totals))


@query
def attribution_models(m: Marts) -> DataFrame:
    m.share_sessions()
    return report(attribution.attribution_by_channel(m.sessions))


@query
def last_non_direct(m: Marts) -> DataFrame:
    m.share_sessions()
    return report(attribution.last_non_direct(m.sessions, 7), "session_key", "event_date", "channel_group", "last_non_direct_channel")
