"""Additive funnel aggregates by day, week and single dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import FUNNEL_STEPS, REACHED, surrogate_key, time_grain
from funnelspark.functions.numeric import money_sum, safe_divide
from funnelspark.operators.sessions import has_revenue

DAILY_KEYS = ("event_date", "channel_group", "device_category", "country", "is_new_user")

# count column -> flag column; "purchase" is called purchasing in the counts
STEP_COUNTS = {
    ("purchasing" if step == "purchase" else step) + "_sessions": flag
    for step, flag in zip(FUNNEL_STEPS, REACHED)
}
COUNTS = ("sessions", *STEP_COUNTS)
ADDITIVE = (*COUNTS, "transactions", "revenue")


def funnel_counts(distinct: bool = False) -> list[Column]:
    """Sessions, sessions per step, paying sessions and revenue.

    A session has exactly one row in the facts, so conditional row counts equal
    distinct session counts and need one aggregation buffer each; ``distinct``
    asks for real distinct counts on input that may repeat sessions.
    """
    def number(condition: Column | None) -> Column:
        if distinct:
            key = F.col("session_key") if condition is None else F.when(condition, F.col("session_key"))
            return F.count_distinct(key)
        return F.count("session_key") if condition is None else F.count_if(condition & F.col("session_key").isNotNull())

    return [
        number(None).alias("sessions"),
        *[number(F.col(flag)).alias(name) for name, flag in STEP_COUNTS.items()],
        number(has_revenue()).alias("transactions"),
        money_sum("session_revenue").alias("revenue"),
    ]


def fct_daily_funnel(funnel: DataFrame, distinct: bool = False) -> DataFrame:
    """Counts by day, channel, device, country and new/returning; no stored rates."""
    daily = funnel.groupBy(*DAILY_KEYS).agg(*funnel_counts(distinct))
    return daily.select(surrogate_key(*DAILY_KEYS).alias("daily_funnel_key"), *DAILY_KEYS, *ADDITIVE)


def funnel_by_dim(funnel: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The same counts for one dimension at a time, long format.

    Sessions are first reduced to the combinations of all asked dimensions;
    only those few rows are then unpivoted.
    """
    cells = funnel.groupBy("event_date", *dims).agg(*funnel_counts())
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("dimension_value")) for d in dims
    ])
    long = cells.select("event_date", F.inline(pairs), *ADDITIVE)
    return sum_counts(long, "event_date", "dimension", "dimension_value", columns=ADDITIVE)


def sum_counts(df: DataFrame, *keys, columns: Sequence[str] = (*COUNTS, "revenue")) -> DataFrame:
    sums = [
        (money_sum(c) if c == "revenue" else F.sum(c)).alias(c) for c in columns
    ]
    return df.groupBy(*keys).agg(*sums)


def weekly_funnel(funnel: DataFrame) -> DataFrame:
    """Counts and revenue by Monday week, channel and device; missing values are 0."""
    week = time_grain("event_date", "week").alias("week")
    weekly = funnel.groupBy(week, "channel_group", "device_category").agg(*funnel_counts())
    return weekly.drop("transactions").fillna(0, [*COUNTS, "revenue"])


def weekly_from_daily(daily: DataFrame) -> DataFrame:
    """The weekly funnel from the daily one: all columns are additive."""
    week = time_grain("event_date", "week").alias("week")
    return sum_counts(daily, week, "channel_group", "device_category").fillna(0, [*COUNTS, "revenue"])


def conversion_series(weekly: DataFrame, by: str = "week") -> DataFrame:
    """Overall conversion per period: sum of purchases over sum of sessions."""
    totals = weekly.groupBy(by).agg(
        F.sum("sessions").alias("sessions"), F.sum("purchasing_sessions").alias("purchasing_sessions")
    )
    return totals.withColumn("conversion", safe_divide("purchasing_sessions", "sessions"))


def base_segments(weekly: DataFrame) -> DataFrame:
    """Conversion counts per channel / device cell over all weeks, cells with traffic only."""
    from funnelspark.functions.events import segment_label

    cells = weekly.groupBy(segment_label("channel_group", "device_category").alias("segment")).agg(
        F.sum("purchasing_sessions").alias("num"), F.sum("sessions").alias("den")
    )
    return cells.filter(F.col("den") > 0)
