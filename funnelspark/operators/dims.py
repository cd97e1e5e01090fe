"""Conformed dimensions: channels, dates, users, items and item history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelspark.functions.events import calendar_parts
from funnelspark.functions.numeric import money, money_sum

# Channel, is_paid, is_organic in display order.
CHANNELS = (
    ("Direct", False, False),
    ("Organic Search", False, True),
    ("Paid Search", True, False),
    ("Display", True, False),
    ("Paid Social", True, False),
    ("Organic Social", False, True),
    ("Email", False, True),
    ("Affiliates", True, False),
    ("Referral", False, True),
    ("Other", False, False),
)


def dim_channels(spark: SparkSession) -> DataFrame:
    rows = [(name, paid, organic, order) for order, (name, paid, organic) in enumerate(CHANNELS, start=1)]
    table = spark.createDataFrame(rows, "channel_group string, is_paid boolean, is_organic boolean, channel_group_order int")
    return table.select(F.md5("channel_group").alias("channel_key"), "*")


def dim_date(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return date_spine(spark.range(1).select(F.lit(start).alias("first_day"), F.lit(end).alias("last_day")))


def date_spine(bounds: DataFrame) -> DataFrame:
    """Calendar rows for every day of the one-row range ``first_day .. last_day``."""
    days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("event_date"))
    key = F.md5(F.col("event_date").cast("string")).alias("date_key")
    return days.select(key, "event_date", *calendar_parts())


def dim_users(sessions: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per user: first session's attribution and lifetime totals."""
    first = F.min(F.struct("session_start_ts", "session_key", "source", "medium", "channel_group")).alias("first")
    users = sessions.groupBy("user_pseudo_id").agg(
        first,
        F.count("session_key").alias("total_sessions"),
        F.coalesce(money_sum("session_revenue"), F.lit(0.0)).alias("total_revenue"),
        F.bool_or("is_new_user").alias("is_new_user"),
    )
    flat = users.select(
        F.col("user_pseudo_id").alias("user_key"),
        F.col("first.session_start_ts").alias("first_touch_ts"),
        F.col("first.source").alias("first_touch_source"),
        F.col("first.medium").alias("first_touch_medium"),
        F.col("first.channel_group").alias("channel_group"),
        "total_sessions", "total_revenue",
        (F.col("total_revenue") > 0).alias("is_purchaser"),
        "is_new_user",
    )
    keys = channels.select("channel_group", F.col("channel_key").alias("first_channel_key"))
    return flat.join(keys, "channel_group", "left").drop("channel_group")


def item_observations(raw: DataFrame) -> DataFrame:
    """Attributes of every item seen in a view or purchase."""
    seen = raw.select("event_timestamp", F.explode("items").alias("item"))
    return seen.select(
        F.col("item.item_id").alias("item_key"),
        F.timestamp_micros("event_timestamp").alias("observed_ts"),
        "item.item_name", "item.item_brand", "item.item_category", "item.price_in_usd",
    )


def dim_items(observations: DataFrame) -> DataFrame:
    """Latest known attributes per item."""
    attributes = [c for c in observations.columns if c not in ("item_key", "observed_ts", "price_in_usd")]
    latest = observations.groupBy("item_key").agg(
        F.max(F.struct("observed_ts", "price_in_usd", *attributes)).alias("latest")
    )
    return latest.select(
        "item_key", *[F.col(f"latest.{c}") for c in attributes],
        F.col("latest.price_in_usd").alias("current_price_in_usd"),
    )


def snap_items(observations: DataFrame, tracked=("price_in_usd", "item_category", "item_name")) -> DataFrame:
    """Version history: a new version on each day a tracked attribute differs from the day before it.

    Observations are reduced to the last state of an item on a day, as a daily
    snapshot run would see it. The window then holds one row per item and day,
    however often an item is seen.
    """
    daily = observations.groupBy("item_key", F.to_date("observed_ts").alias("day")).agg(
        F.max(F.struct("observed_ts", *tracked)).alias("state")
    )
    daily = daily.select("item_key", "day", *[F.col(f"state.{c}") for c in tracked])
    by_day = Window.partitionBy("item_key").orderBy("day")
    changed = F.lit(False)
    for c in tracked:
        value = money(c) if c == "price_in_usd" else F.col(c)
        changed = changed | ~value.eqNullSafe(F.lag(value).over(by_day))
    first = F.row_number().over(by_day) == 1
    versions = daily.withColumn("starts", first | changed).filter("starts").drop("starts")
    return versions.select(
        "item_key", *tracked, F.col("day").alias("valid_from"),
        F.lead("day").over(by_day).alias("valid_to"),
        F.row_number().over(by_day).alias("version"),
    )
