"""Data checks. Each gives one row: rule, rows checked, violations, status."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import REACHED, any_of
from funnelspark.functions.numeric import money_sum, safe_divide

# Bounds of a plausible daily conversion, freshness and reconcile limits.
CONVERSION_LOW, CONVERSION_HIGH, CONVERSION_MAX = 0.0005, 0.20, 1.0
WARN_HOURS, ERROR_HOURS = 36, 48
REVENUE_TOLERANCE = 0.01


def _status(violations: str = "violations") -> Column:
    return F.when(F.col(violations) == 0, "pass").otherwise("fail")


# ── row rules: the condition a broken row meets ──────────────────────────────

def is_null(column: str, where: Column | None = None) -> Column:
    missing = F.col(column).isNull()
    return missing if where is None else missing & where


def not_in(column: str, values: Sequence) -> Column:
    return ~F.col(column).isin(*values)


def outside(column: str, low=None, high=None) -> Column:
    sides = []
    if low is not None:
        sides.append(F.col(column) < low)
    if high is not None:
        sides.append(F.col(column) > high)
    return any_of(sides)


def is_false(expression: Column) -> Column:
    return ~expression


def not_monotonic() -> Column:
    """A later step reached without the step before it."""
    return any_of([F.col(later) > F.col(earlier) for earlier, later in zip(REACHED, REACHED[1:])])


def counts_not_monotonic(columns: Sequence[str]) -> Column:
    return any_of([F.col(later) > F.col(earlier) for earlier, later in zip(columns, columns[1:])])


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """All row rules of a table in one pass; NULL conditions do not count as broken."""
    counted = df.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(c).alias(name) for name, c in rules.items()])
    entries = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules])
    report = counted.select("checked", F.inline(entries))
    return report.select("rule", "checked", "violations", _status().alias("status"))


def violators(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


# ── rules over groups of rows ─────────────────────────────────────────────────

def check_unique(df: DataFrame, rule: str, *columns: str) -> DataFrame:
    """Keys that occur more than once; rows with a NULL key are left out."""
    keys = df.select(*columns).dropna()
    counts = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    report = counts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("checked"), F.count_if(F.col("rows") > 1).alias("violations")
    )
    return report.select(F.lit(rule).alias("rule"), "checked", "violations", _status().alias("status"))


def check_relationship(child: DataFrame, column: str, parent: DataFrame, parent_column: str, rule: str) -> DataFrame:
    """Child rows whose value the parent does not hold.

    Child values are counted first, so the anti-join sees each value once.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(parent_column).alias("value")).distinct().withColumn("known", F.lit(True))
    report = values.join(known, "value", "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("rows"))), F.lit(0)).alias("violations"),
    )
    return report.select(F.lit(rule).alias("rule"), "checked", "violations", _status().alias("status"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def conversion_bounds(daily: DataFrame) -> DataFrame:
    """Each day's conversion with a flag when it is not plausible."""
    days = daily.groupBy("event_date").agg(
        F.sum("purchasing_sessions").alias("purchasers"), F.sum("sessions").alias("sessions")
    ).filter(F.col("sessions") > 0)
    rated = days.withColumn("conversion", safe_divide("purchasers", "sessions"))
    broken = (
        (F.col("conversion") > CONVERSION_MAX) | (F.col("conversion") < CONVERSION_LOW) | (F.col("conversion") > CONVERSION_HIGH)
    )
    return rated.withColumn("out_of_bounds", broken)


def raw_revenue_total(raw: DataFrame) -> DataFrame:
    """Purchase revenue of the raw events, each transaction counted once."""
    per_transaction = (
        raw.filter((F.col("event_name") == "purchase") & F.col("ecommerce.transaction_id").isNotNull())
        .groupBy("ecommerce.transaction_id")
        .agg(F.max("ecommerce.purchase_revenue_in_usd").alias("revenue"))
    )
    return per_transaction.agg(F.coalesce(money_sum("revenue"), F.lit(0.0)).alias("amount"))


def revenue_reconciles(mart: DataFrame, column: str, raw: DataFrame, rule: str, tolerance: float = REVENUE_TOLERANCE) -> DataFrame:
    """Mart revenue against raw revenue, relative drift within tolerance."""
    total = mart.agg(F.coalesce(money_sum(column), F.lit(0.0)).alias("mart_amount"))
    both = total.withColumn("raw_amount", raw_revenue_total(raw).scalar())
    drift = safe_divide(F.abs(F.col("mart_amount") - F.col("raw_amount")), F.col("raw_amount"))
    both = both.withColumn("relative_drift", drift)
    broken = F.coalesce(F.col("relative_drift") > tolerance, F.lit(False)) | (
        (F.col("raw_amount") == 0) & (F.col("mart_amount") != 0)
    )
    return both.select(
        F.lit(rule).alias("rule"), "mart_amount", "raw_amount", "relative_drift",
        F.when(broken, "fail").otherwise("pass").alias("status"),
    )


# ── time rules ────────────────────────────────────────────────────────────────

def freshness(df: DataFrame, as_of: dt.datetime, loaded_at: Column | str = "event_date") -> DataFrame:
    """Age in hours of the newest row against the warn and error limits."""
    loaded_at = F.col(loaded_at) if isinstance(loaded_at, str) else loaded_at
    newest = df.agg(F.max(loaded_at.cast("timestamp")).alias("newest"))
    age = F.timestamp_diff("HOUR", F.col("newest"), F.lit(as_of))
    aged = newest.withColumn("age_hours", age)
    status = (
        F.when(F.col("age_hours").isNull() | (F.col("age_hours") > ERROR_HOURS), "error")
        .when(F.col("age_hours") > WARN_HOURS, "warn").otherwise("pass")
    )
    return aged.select(F.col("newest").cast("date").alias("newest_date"), "age_hours", status.alias("status"))


def recency(daily: DataFrame, as_of: dt.date, max_days: int = 2) -> DataFrame:
    """The newest day is recent, and the day before ``as_of`` holds rows."""
    yesterday = as_of - dt.timedelta(days=1)
    facts = daily.agg(
        F.count(F.lit(1)).alias("checked"), F.max("event_date").alias("newest"),
        F.count_if(F.col("event_date") == F.lit(yesterday)).alias("rows_yesterday"),
    )
    stale = F.coalesce(F.date_diff(F.lit(as_of), F.col("newest")) > max_days, F.lit(True)).cast("long")
    empty = (F.col("rows_yesterday") < 1).cast("long")
    entries = F.array(
        F.struct(F.lit("newest day is recent").alias("rule"), stale.alias("violations")),
        F.struct(F.lit("yesterday has rows").alias("rule"), empty.alias("violations")),
    )
    return facts.select("checked", F.inline(entries)).select("rule", "checked", "violations", _status().alias("status"))


def all_checks(*reports: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)
