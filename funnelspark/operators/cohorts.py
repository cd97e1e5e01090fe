"""Acquisition cohorts and retention.

Sessions are reduced to distinct (user, day) pairs before anything is gathered
per user, so a user holds at most one entry per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import time_grain
from funnelspark.functions.numeric import safe_divide

COHORT_DIMS = ("channel_group", "source", "medium", "campaign", "device_category", "country", "is_new_user")
HORIZONS = (1, 7, 30)


def user_days(sessions: DataFrame, dims=COHORT_DIMS) -> DataFrame:
    """One row per user: first session's key and dimensions, and the sorted days with a session.

    Without dimensions only user and day are read.
    """
    if not dims:
        days = sessions.select("user_pseudo_id", "event_date").distinct().groupBy("user_pseudo_id").agg(
            F.array_sort(F.collect_list("event_date")).alias("days"))
        return days.select("user_pseudo_id", F.get("days", F.lit(0)).alias("first_date"), "days")
    daily = sessions.groupBy("user_pseudo_id", "event_date").agg(
        F.min(F.struct("session_start_ts", "session_key", *dims)).alias("first")
    )
    users = daily.groupBy("user_pseudo_id").agg(
        F.min("first").alias("first"), F.array_sort(F.collect_list("event_date")).alias("days")
    )
    return users.select(
        "user_pseudo_id", F.col("first.session_key").alias("session_key"), F.get("days", F.lit(0)).alias("first_date"), "days",
        *[F.col(f"first.{d}").alias(d) for d in dims],
    )


def fct_cohorts(sessions: DataFrame) -> DataFrame:
    """Cohort size and users back within 1, 7 and 30 days, by first day and first session's dimensions."""
    return cohorts_of(user_days(sessions))


def cohorts_of(users: DataFrame) -> DataFrame:
    """``fct_cohorts`` from one row per user.

    Someone returned within N days exactly when their second active day is at
    most N days after the first, so no join of users to sessions is needed.
    """
    users = users.withColumn("gap", F.date_diff(F.get("days", F.lit(1)), "first_date"))
    retained = [F.count_if(F.col("gap") <= n).alias(f"retained_users_d{n}") for n in HORIZONS]
    keys = [F.col("first_date").alias("event_date"), *COHORT_DIMS]
    cohorts = users.groupBy(*keys).agg(F.count(F.lit(1)).alias("cohort_size"), *retained)
    return cohorts.select(time_grain("event_date", "week").alias("cohort_week"), "*")


def retention_curve(sessions: DataFrame) -> DataFrame:
    """Active users of each weekly cohort by days since the cohort's Monday."""
    return retention_curve_of(user_days(sessions, ()))


def retention_curve_of(users: DataFrame) -> DataFrame:
    """``retention_curve`` from one row per user; users are counted on their first day on the way."""
    cohort = time_grain("first_date", "week").alias("cohort_week")
    active = users.select(cohort, "first_date", F.explode("days").alias("day"))
    cells = active.groupBy("cohort_week", F.date_diff("day", "cohort_week").alias("age_days")).agg(
        F.count(F.lit(1)).alias("active_users"), F.count_if(F.col("day") == F.col("first_date")).alias("new_users"))
    sizes = cells.groupBy("cohort_week").agg(F.sum("new_users").alias("cohort_size"))
    joined = cells.drop("new_users").join(sizes, "cohort_week")
    return joined.withColumn("retention_rate", safe_divide("active_users", "cohort_size"))


def cohort_retention(sessions: DataFrame, periods: int, grain: str = "week") -> DataFrame:
    """Share of each cohort active 0 .. periods-1 grains after its first, one column per age.

    A period that starts after the newest day of the data is NULL: nobody could be seen in it.
    """
    return cohort_retention_of(user_days(sessions, ()), sessions.agg(F.max("event_date")).scalar(), periods, grain)


def cohort_retention_of(users: DataFrame, newest: Column, periods: int, grain: str = "week") -> DataFrame:
    """``cohort_retention`` from one row per user and the newest day of the data."""
    if grain not in ("day", "week", "month"):
        raise ValueError(f"unknown cohort grain {grain!r}")
    cohort = time_grain("first_date", grain)
    period_start = F.transform("days", lambda d: time_grain(d, grain))
    activity = users.select(cohort.alias("cohort"), F.explode(F.array_distinct(period_start)).alias("period"))
    if grain == "month":
        age = F.months_between("period", "cohort").cast("int")
    else:
        age = (F.date_diff("period", "cohort") / (7 if grain == "week" else 1)).cast("int")
    matrix = (
        activity.withColumn("age", age)
        .groupBy("cohort").pivot("age", list(range(periods))).agg(F.count(F.lit(1)))
        .fillna(0)
    )
    begins = lambda p: F.expr(f"cohort + make_interval(0, {p}, 0, 0)" if grain == "month" else f"date_add(cohort, {p * (7 if grain == 'week' else 1)})")
    # everyone is active in period 0, so its count is the size of the cohort
    return matrix.select(
        "cohort", F.col("0").alias("cohort_size"),
        *[F.when(begins(p) <= newest, safe_divide(str(p), "0")).alias(f"period_{p}") for p in range(periods)],
    )
