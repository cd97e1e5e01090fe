"""Attribution models over the sessions of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions.numeric import money_sum

LOOKBACK_DAYS = 90
MODELS = ("first_touch", "last_touch", "last_non_direct")


def last_non_direct(sessions: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Each session with the latest channel other than Direct up to it, within the look-back.

    Two levels keep windows small: earlier sessions of the same user and day,
    then the last channel of each earlier day. A user's session id is a second
    of the day, so the first window is bounded by the seconds of one day and the
    second by the days of the look-back; no window spans a user's history.
    """
    channel = F.when(F.col("channel_group") != "Direct", F.col("channel_group"))
    keyed = sessions.withColumn("own_channel", channel)
    same_day = (
        Window.partitionBy("user_pseudo_id", "event_date")
        .orderBy("session_start_ts", "session_key")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    today = keyed.withColumn("day_channel", F.last("own_channel", ignorenulls=True).over(same_day))

    by_day = keyed.groupBy("user_pseudo_id", "event_date").agg(
        F.max(
            F.when(F.col("own_channel").isNotNull(), F.struct("session_start_ts", "session_key", "own_channel"))
        ).alias("last_of_day")
    )
    earlier = (
        Window.partitionBy("user_pseudo_id").orderBy(F.unix_date("event_date")).rangeBetween(-lookback_days, -1)
    )
    before = by_day.select(
        "user_pseudo_id", "event_date",
        F.last("last_of_day.own_channel", ignorenulls=True).over(earlier).alias("earlier_channel"),
    )
    joined = today.join(before, ["user_pseudo_id", "event_date"])
    return joined.withColumn(
        "last_non_direct_channel", F.coalesce("day_channel", "earlier_channel", F.lit("Direct"))
    ).drop("own_channel", "day_channel", "earlier_channel")


def first_touch(sessions: DataFrame) -> DataFrame:
    """The channel of each user's first session."""
    first = sessions.groupBy("user_pseudo_id").agg(
        F.min(F.struct("session_start_ts", "session_key", "channel_group")).alias("first")
    )
    return first.select("user_pseudo_id", F.col("first.channel_group").alias("first_touch_channel"))


def attribute_sessions(sessions: DataFrame, models=MODELS) -> DataFrame:
    """Converting sessions with the channel each model credits."""
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown attribution model {sorted(unknown)}")
    converting = last_non_direct(sessions).filter("reached_purchase")
    credited = converting.join(first_touch(sessions), "user_pseudo_id")
    columns = {
        "first_touch": "first_touch_channel", "last_touch": "channel_group",
        "last_non_direct": "last_non_direct_channel",
    }
    entries = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(columns[m]).alias("credited_channel")) for m in models
    ])
    return credited.select("session_key", "user_pseudo_id", "event_date", "session_revenue", F.inline(entries))


def attribution_by_channel(sessions: DataFrame, models=MODELS) -> DataFrame:
    credited = attribute_sessions(sessions, models)
    return credited.groupBy("model", "credited_channel").agg(
        F.count(F.lit(1)).alias("conversions"), money_sum("session_revenue").alias("revenue")
    )
