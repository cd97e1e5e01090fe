"""Session tables: attributes, funnel reach and revenue per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import (
    REACHED, channel_group, engaged, reached_flags, session_key, session_number_bucket, step_rank,
)
from funnelspark.functions.numeric import money, money_sum

SESSION = ("user_pseudo_id", "ga_session_id")

# event column -> session column, both reduced by max()
MAXED = {
    "event_source": "event_source", "first_touch_source": "first_touch_source",
    "event_medium": "event_medium", "first_touch_medium": "first_touch_medium",
    "event_campaign": "event_campaign", "first_touch_campaign": "first_touch_campaign",
    "gclid": "gclid", "device_category": "device_category", "operating_system": "operating_system",
    "browser": "browser", "country": "country", "region": "region", "city": "city",
    "ga_session_number": "ga_session_number",
}


def with_session(stg: DataFrame) -> DataFrame:
    """Events that belong to a session."""
    return stg.filter(F.col("ga_session_id").isNotNull())


def _attributes() -> list[Column]:
    page = F.when(
        F.col("page_location").isNotNull(), F.struct("event_timestamp", "page_location")
    )
    return [
        F.min("event_date").alias("session_date"),
        F.min("event_timestamp").alias("session_start_ts"),
        F.max("event_timestamp").alias("session_end_ts"),
        F.min(page).alias("first_page"),
        *[F.max(column).alias(name) for column, name in MAXED.items()],
        F.bool_or(engaged()).alias("engaged_session"),
        F.bool_or(F.coalesce(F.col("ga_session_number") == 1, F.lit(False))).alias("is_new_user"),
    ]


def _merge_attributes() -> list[Column]:
    """Combines partial rows of one session that ``_attributes`` produced."""
    return [
        F.min("session_date").alias("session_date"),
        F.min("session_start_ts").alias("session_start_ts"),
        F.max("session_end_ts").alias("session_end_ts"),
        F.min("first_page").alias("first_page"),
        *[F.max(name).alias(name) for name in MAXED.values()],
        F.bool_or("engaged_session").alias("engaged_session"),
        F.bool_or("is_new_user").alias("is_new_user"),
    ]


def _session_columns() -> list[Column]:
    source = F.coalesce("event_source", "first_touch_source")
    medium = F.coalesce("event_medium", "first_touch_medium")
    return [
        session_key().alias("session_key"),
        F.col("user_pseudo_id"),
        F.col("ga_session_id"),
        F.col("session_date"),
        F.col("session_start_ts"),
        F.col("session_end_ts"),
        F.col("first_page.page_location").alias("landing_page"),
        source.alias("session_source"),
        medium.alias("session_medium"),
        F.coalesce("event_campaign", "first_touch_campaign").alias("session_campaign"),
        F.col("gclid"),
        *[F.col(c) for c in ("device_category", "operating_system", "browser", "country", "region", "city")],
        F.col("engaged_session"),
        F.col("is_new_user"),
        F.col("ga_session_number"),
        channel_group(source, medium, "gclid").alias("channel_group"),
    ]


def int_sessionized(stg: DataFrame) -> DataFrame:
    """One row per session: times, attribution, device, geography, engagement.

    The key pair stands for the session key, so the hash is computed once per
    session and not once per event.
    """
    return with_session(stg).groupBy(*SESSION).agg(*_attributes()).select(*_session_columns())


def int_funnel_steps(stg: DataFrame) -> DataFrame:
    """One row per session: six cumulative flags and revenue counted once per transaction.

    Two groupings: the first keeps the largest revenue of each (session,
    transaction), the second adds them up. Rows without a transaction id form
    one group of their session.
    """
    per_transaction = (
        with_session(stg)
        .groupBy("session_key", "transaction_id")
        .agg(
            F.min("event_date").alias("session_date"),
            F.max(step_rank()).alias("furthest_step"),
            F.max("purchase_revenue_in_usd").alias("revenue"),
        )
    )
    per_session = per_transaction.groupBy("session_key").agg(
        F.min("session_date").alias("session_date"),
        F.max("furthest_step").alias("furthest_step"),
        money_sum("revenue").alias("session_revenue"),
        F.max("transaction_id").alias("transaction_id"),
    )
    return per_session.select(
        "session_key", "session_date", *reached_flags(),
        F.coalesce("session_revenue", F.lit(0.0)).alias("session_revenue"), "transaction_id",
    )


def _facts(extra: list[str]) -> list[Column]:
    return [
        F.col("session_key"),
        F.col("user_pseudo_id"),
        F.col("session_date").alias("event_date"),
        F.col("channel_group"),
        F.col("session_source").alias("source"),
        F.col("session_medium").alias("medium"),
        F.col("session_campaign").alias("campaign"),
        *[F.col(c) for c in ("landing_page", "device_category", "operating_system", "browser", "country", "region")],
        F.col("is_new_user"),
        F.col("engaged_session"),
        session_number_bucket().alias("session_number_bucket"),
        *[F.col(c) for c in extra],
    ]


def fct_funnel(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """Session facts by a one-to-one join of attributes and funnel steps."""
    reach = steps.select("session_key", *REACHED, "session_revenue")
    return sessions.join(reach, "session_key").select(*_facts([*REACHED, "session_revenue"]))


def session_rollup(stg: DataFrame) -> DataFrame:
    """Attributes, reach and revenue of every session from a single scan.

    Equal to ``fct_funnel(int_sessionized, int_funnel_steps)`` plus the columns
    of ``fct_sessions``, without their second scan and their join: events are
    first reduced to (session, transaction), then to the session. Both steps
    combine on the map side, so a session with very many events arrives at its
    reducer as a handful of rows.
    """
    per_transaction = with_session(stg).groupBy(*SESSION, "transaction_id").agg(
        *_attributes(),
        F.max(step_rank()).alias("furthest_step"),
        F.max("purchase_revenue_in_usd").alias("revenue"),
        F.count(F.lit(1)).alias("event_count"),
        F.sum("engagement_time_msec").alias("engagement_time_msec"),
    )
    per_session = per_transaction.groupBy(*SESSION).agg(
        *_merge_attributes(),
        F.max("furthest_step").alias("furthest_step"),
        money_sum("revenue").alias("session_revenue"),
        F.sum("event_count").alias("event_count"),
        F.sum("engagement_time_msec").alias("engagement_time_msec"),
    )
    return per_session.select(
        *_session_columns(), *reached_flags(),
        F.coalesce("session_revenue", F.lit(0.0)).alias("session_revenue"),
        "event_count", "engagement_time_msec",
    )


def funnel_facts(rollup: DataFrame) -> DataFrame:
    """``fct_funnel`` from the rollup."""
    return rollup.select(*_facts([*REACHED, "session_revenue"]))


def fct_sessions(rollup: DataFrame) -> DataFrame:
    """The session entity: facts plus ordinals, times, event count, engagement time."""
    extra = [
        "ga_session_id", "ga_session_number", "session_start_ts", "session_end_ts",
        *REACHED, "session_revenue", "event_count", "engagement_time_msec",
    ]
    return rollup.select(*_facts(extra))


def has_revenue() -> Column:
    return F.col("reached_purchase") & (money("session_revenue") > 0)
