"""Raw event scan and the channel mapping seed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.schema import CHANNEL_SEED, RAW_EVENT

# The channel mapping seed, in order.
SEED_ROWS = (
    ("(direct)", "(none)", "Direct"),
    ("google", "cpc", "Paid Search"),
    ("bing", "cpc", "Paid Search"),
    ("google", "organic", "Organic Search"),
    ("bing", "organic", "Organic Search"),
    ("facebook", "cpc", "Paid Social"),
    ("instagram", "paid", "Paid Social"),
    ("facebook", "social", "Organic Social"),
    ("instagram", "social", "Organic Social"),
    ("youtube", "social", "Organic Social"),
    ("dv360", "display", "Display"),
    ("google", "display", "Display"),
    ("email", "email", "Email"),
    ("newsletter", "email", "Email"),
    ("partner", "affiliate", "Affiliates"),
    ("some-blog", "referral", "Referral"),
    ("t.co", "referral", "Referral"),
    ("other", "unknown", "Other"),
)

# Default window of the raw event table.
DEFAULT_START = dt.date(2020, 11, 1)
DEFAULT_END = dt.date(2021, 1, 31)


def date_window(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows of the closed date window; on a date-partitioned scan only its partitions are read."""
    if start is not None:
        df = df.filter(F.col("event_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("event_date") <= F.lit(end).cast("date"))
    return df


def read_events(spark: SparkSession, *paths: str, start=None, end=None) -> DataFrame:
    """Nested raw events from one or more folders partitioned by ``event_date``."""
    return date_window(spark.read.schema(RAW_EVENT).parquet(*paths), start, end)


def read_events_default_window(spark: SparkSession, *paths: str) -> DataFrame:
    return read_events(spark, *paths, start=DEFAULT_START, end=DEFAULT_END)


def read_event_shards(spark: SparkSession, pattern: str, start=None, end=None) -> DataFrame:
    """Union of day folders named ``<prefix>YYYYMMDD``; the name gives the date, and only files of the window are read.

    Shards may differ in schema: all are read with today's, which the parquet
    reader maps onto each file by name. A column, or a field at any depth, that a
    shard lacks is NULL there; narrower numbers are widened; fields that are gone
    from the schema aren't read.
    """
    shards = spark.read.schema(RAW_EVENT).parquet(pattern)
    suffix = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{8})(?:/[^/]*)?$", 1)
    return date_window(shards.withColumn("event_date", F.to_date(suffix, "yyyyMMdd")), start, end)


def write_seed(spark: SparkSession, path: str, rows=SEED_ROWS) -> None:
    """Write a mapping as CSV with a header."""
    spark.createDataFrame(list(rows), CHANNEL_SEED).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """The source/medium to channel mapping; every column is text."""
    return spark.read.schema(CHANNEL_SEED).option("header", True).csv(path)


def seed_channel(df: DataFrame, seed: DataFrame, source: str, medium: str) -> DataFrame:
    """Adds ``seed_channel``: the channel of the first seed row that fits source and medium, else NULL.

    Rows count in the order of the seed. Text is compared in lower case; a seed
    row without source or medium fits any. A lookup is four equi-joins' worth of
    keys for each distinct pair, never a comparison with all rows.
    """
    ranked = seed.withColumn("rank", F.monotonically_increasing_id())
    key = lambda c: F.lower(F.coalesce(F.col(c), F.lit("*")))
    rules = ranked.groupBy(key("source").alias("s"), key("medium").alias("m")).agg(F.min(F.struct("rank", "channel_group")).alias("rule"))
    own = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    ways = F.array(*(F.struct(s.alias("s"), m.alias("m")) for s in (own("same_source"), F.lit("*")) for m in (own("same_medium"), F.lit("*"))))
    pairs = df.select(F.col(source).alias("same_source"), F.col(medium).alias("same_medium")).distinct()
    found = pairs.select("same_source", "same_medium", F.inline(ways)).join(rules, ["s", "m"]).groupBy("same_source", "same_medium").agg(F.min("rule").alias("rule"))
    found = found.select("same_source", "same_medium", F.col("rule.channel_group").alias("seed_channel"))
    same = F.col(source).eqNullSafe(F.col("same_source")) & F.col(medium).eqNullSafe(F.col("same_medium"))
    return df.join(found, same, "left").drop("same_source", "same_medium")
