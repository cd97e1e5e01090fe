"""Data checks and the incremental and streaming builds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import channel_group, event_param
from funnelspark.functions.numeric import money_sum
from funnelspark.operators import checks
from funnelspark.operators.checks import is_false, is_null, not_in, outside
from funnelspark.operators.daily import COUNTS
from funnelspark.operators.dims import CHANNELS, dim_channels
from funnelspark.plans.common import query, report
from funnelspark.plans.marts import Marts
from funnelspark.session import materialize, scratch_path
from funnelspark.sources.daytable import DayTable
from funnelspark.sources.events import read_event_shards, read_seed, seed_channel, write_seed
from funnelspark.streaming import daily_funnel

CHANNEL_NAMES = [name for name, _, _ in CHANNELS]
AS_OF = dt.datetime(2024, 2, 1, 6, 0)


@query
def check_not_null(m: Marts) -> DataFrame:
    in_session = F.col("ga_session_id").isNotNull()
    events = checks.check_rows(m.stg, {
        "events.session_key": is_null("session_key", in_session),
        "events.event_date": is_null("event_date"),
        "events.event_timestamp": is_null("event_timestamp"),
        "events.user_pseudo_id": is_null("user_pseudo_id"),
    })
    sessions = checks.check_rows(m.funnel, {
        f"sessions.{c}": is_null(c)
        for c in ("session_key", "event_date", "channel_group", "engaged_session", "is_new_user", "reached_purchase", "session_revenue")
    })
    return checks.all_checks(events, sessions)


@query
def check_unique(m: Marts) -> DataFrame:
    m.share_sessions()
    return checks.all_checks(
        checks.check_unique(m.funnel, "sessions.session_key", "session_key"),
        checks.check_unique(m.daily, "daily.daily_funnel_key", "daily_funnel_key"),
        checks.check_unique(m.orders, "orders.order_key", "order_key"),
        checks.check_unique(m.raw.select("ecommerce.transaction_id"), "raw.transaction_id", "transaction_id"),
    )


@query
def check_accepted_values(m: Marts) -> DataFrame:
    return checks.check_rows(m.funnel, {
        "sessions.channel_group": not_in("channel_group", CHANNEL_NAMES),
        "sessions.device_category without tablet": not_in("device_category", ["mobile", "desktop"]),
    })


@query
def check_ranges(m: Marts) -> DataFrame:
    m.share_sessions()
    orders = checks.check_rows(m.orders, {
        "orders.gross_revenue": outside("gross_revenue", low=0),
        "orders.net_revenue": outside("net_revenue", low=0),
        "orders.gross_revenue up to 100": outside("gross_revenue", low=0, high=100),
    })
    return checks.all_checks(orders, checks.check_rows(m.daily, {"daily.sessions": outside("sessions", low=0)}))


@query
def check_relationships(m: Marts) -> DataFrame:
    m.share_sessions().share_orders()
    parents = dim_channels(m.spark)
    return checks.all_checks(
        checks.check_relationship(m.funnel, "channel_group", parents, "channel_group", "sessions.channel_group"),
        checks.check_relationship(m.orders, "channel_group", parents, "channel_group", "orders.channel_group"),
        checks.check_relationship(m.orders, "session_key", m.funnel, "session_key", "orders.session_key"),
        checks.check_relationship(m.table("orders"), "o_custkey", m.table("customer").filter("c_acctbal > 0"), "c_custkey", "orders of customers in credit"),
    )


@query
def check_expression(m: Marts) -> DataFrame:
    return checks.check_rows(m.daily, {
        "purchasing_sessions <= sessions": is_false(F.col("purchasing_sessions") <= F.col("sessions")),
        "revenue >= 0": is_false(F.col("revenue") >= 0),
        "step counts fall": checks.counts_not_monotonic(COUNTS),
    })


@query
def check_monotonic(m: Marts) -> DataFrame:
    return checks.check_rows(m.funnel, {
        "funnel monotonic": checks.not_monotonic(),
        "new users in their first session": is_false(~(F.col("is_new_user") & (F.col("session_number_bucket") != "1"))),
    })


@query
def check_conversion_bounds(m: Marts) -> DataFrame:
    return report(checks.conversion_bounds(m.daily))


@query
def check_revenue_reconcile(m: Marts) -> DataFrame:
    m.share_sessions()
    return report(checks.all_checks(
        checks.revenue_reconciles(m.orders, "gross_revenue", m.raw, "orders.gross_revenue"),
        checks.revenue_reconciles(m.funnel, "session_revenue", m.raw, "sessions.session_revenue"),
    ))


@query
def freshness(m: Marts) -> DataFrame:
    return report(checks.freshness(m.raw, AS_OF))


@query
def recency(m: Marts) -> DataFrame:
    return checks.recency(m.daily, AS_OF.date())


# ── sources ──────────────────────────────────────────────────────────────────

@query
def event_shards(m: Marts) -> DataFrame:
    """Day shards of three schemas as one table: fields that old shards lack, and numbers that were narrower, in a window."""
    raw = materialize(m.raw_with_items, "all-events")
    folder = scratch_path(m.spark, "shards")
    day = F.dayofmonth("event_date")
    old = raw.filter(day <= 10).drop("items").withColumns({
        "device": F.col("device").dropFields("web_info"), "ecommerce": F.col("ecommerce").dropFields("unique_items", "tax_value_in_usd"),
        "geo": F.struct(F.col("geo.country").alias("country"), F.lit("x").alias("continent")),
    })
    narrow = raw.filter((day > 10) & (day <= 20)).withColumns({
        "event_params": F.transform("event_params", lambda p: p.withField("value.int_value", p["value"]["int_value"].cast("int"))),
        "ecommerce": F.col("ecommerce").withField("total_item_quantity", F.col("ecommerce.total_item_quantity").cast("int")),
    })
    for part in (old, narrow, raw.filter(day > 20)):
        # one folder a day, named by its date
        part.withColumn("shard", F.date_format("event_date", "yyyyMMdd")).drop("event_date").write.mode("append").partitionBy("shard").parquet(folder)
    events = read_event_shards(m.spark, f"{folder}/shard=*", dt.date(2024, 1, 3), dt.date(2024, 1, 28))
    return report(events.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("events"), F.count("device.category").alias("devices"), F.count("device.web_info.browser").alias("browsers"), F.count("geo.country").alias("countries"),
        F.count("geo.region").alias("regions"), F.sum("ecommerce.total_item_quantity").alias("quantity"), F.sum("ecommerce.unique_items").alias("unique_items"),
        money_sum("ecommerce.purchase_revenue_in_usd").alias("revenue"), F.sum(event_param("engagement_time_msec", "int")).alias("msec"),
    ))


@query
def channel_seed(m: Marts) -> DataFrame:
    """The mapping seed against the channel rules, for every source and medium of the events."""
    path = scratch_path(m.spark, "seed")
    write_seed(m.spark, path)
    clicked = F.when(F.col("gclid").isNotNull(), F.lit("id"))
    pairs = m.stg.groupBy("event_source", "event_medium", clicked.alias("gclid")).agg(F.count(F.lit(1)).alias("events"))
    both = seed_channel(pairs.withColumn("channel_group", channel_group("event_source", "event_medium", "gclid")), read_seed(m.spark, path), "event_source", "event_medium")
    return both.withColumn("agrees", F.col("seed_channel").eqNullSafe(F.col("channel_group")))


# ── incremental and streaming builds, compared with the batch result ─────────

def _land(raw: DataFrame, path: str | None = None) -> str:
    """Add events to the day folders of a landing place."""
    path = path or scratch_path(raw.sparkSession, "raw-events")
    raw.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)
    return path


def two_day_sessions(raw: DataFrame) -> DataFrame:
    """The events with sessions that span two days."""
    halved = lambda p: p.withField("value.int_value", F.floor(p["value"]["int_value"] / 2).cast("long"))
    return raw.withColumn("event_params", F.transform("event_params", lambda p: F.when(p["key"] == "ga_session_id", halved(p)).otherwise(p)))


def landed_first(raw: DataFrame) -> Column:
    """Events that land in time: not those of the last two days, nor half of the users' of the first day."""
    first, last = (raw.agg(f("event_date")).scalar() for f in (F.min, F.max))
    late_user = F.substring("user_pseudo_id", 2, 20).cast("long") % 2 == 0
    return (F.col("event_date") <= F.date_sub(last, 2)) & ~((F.col("event_date") == first) & late_user)


def _in_two_steps(raw: DataFrame, build) -> str:
    """Land the events in two steps, with ``build`` after each; returns the mart."""
    raw = materialize(raw, "all-events")
    in_time, mart = landed_first(raw), scratch_path(raw.sparkSession, "daily-funnel")
    landing = _land(raw.filter(in_time))
    build(landing, mart)
    _land(raw.filter(~in_time), landing)
    build(landing, mart)
    return mart


@query
def incremental_overwrite(m: Marts) -> DataFrame:
    """A build without the last two days and some old events, then a refresh of the days that change with them."""
    mart = _in_two_steps(m.raw, lambda landing, mart: daily_funnel.refresh_changed(m.spark, landing, mart))
    return report(DayTable(m.spark, mart).read())


@query
def late_moved_sessions(m: Marts) -> DataFrame:
    """The same with sessions of two days, some of which move to the day before when their first events land."""
    mart = _in_two_steps(two_day_sessions(m.raw), lambda landing, mart: daily_funnel.refresh_changed(m.spark, landing, mart))
    return report(DayTable(m.spark, mart).read())


@query
def late_event_counts(m: Marts) -> DataFrame:
    """Events that have landed after the build, by day."""
    raw = materialize(m.raw, "all-events")
    in_time, mart = landed_first(raw), scratch_path(m.spark, "daily-funnel")
    landing = _land(raw.filter(in_time))
    daily_funnel.refresh_changed(m.spark, landing, mart)
    _land(raw.filter(~in_time), landing)
    return daily_funnel.late_events(m.spark, landing, mart)


def _stream(m: Marts, landing: str, mart: str, state: str) -> None:
    stream = daily_funnel.stream_raw_events(m.spark, landing, files_per_batch=20)
    daily_funnel.stream_daily_funnel(stream, mart, state).awaitTermination()


@query
def streaming_daily_funnel(m: Marts) -> DataFrame:
    """The landed files as a stream of micro-batches, each adding its changes to the days it touched."""
    landing, mart = _land(m.raw), scratch_path(m.spark, "daily-funnel")
    _stream(m, landing, mart, scratch_path(m.spark, "stream-state"))
    return report(DayTable(m.spark, mart).read())


@query
def streaming_moved_sessions(m: Marts) -> DataFrame:
    """Sessions of two days; old events land late, and the stream goes on from its checkpoint."""
    state = scratch_path(m.spark, "stream-state")
    mart = _in_two_steps(two_day_sessions(m.raw), lambda landing, mart: _stream(m, landing, mart, state))
    return report(DayTable(m.spark, mart).read())
