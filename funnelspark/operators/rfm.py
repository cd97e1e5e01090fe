"""Recency, frequency and monetary scores per buyer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions.numeric import money, money_sum
from funnelspark.session import materialize

QUINTILES = 5
RANGES = 512


def buyer_totals(orders: DataFrame, as_of: dt.date, user: str, order_date: str, amount: str) -> DataFrame:
    """Days since the last order, number of orders and money per buyer."""
    return orders.groupBy(F.col(user).alias("user_id")).agg(
        F.date_diff(F.lit(as_of), F.max(F.to_date(order_date))).alias("recency"),
        F.count(F.lit(1)).alias("frequency"),
        money_sum(amount).alias("monetary"),
    )


def _quintile(users: DataFrame, column: str, best_is_low: bool) -> DataFrame:
    """Score 1..5 per distinct value, from the share of users below it; equal values score alike.

    Users are first counted per distinct value. The running count over values is
    taken in two steps, inside ranges between quantiles of the values and over the
    range totals, so no task sees more than a few hundredths of the values,
    however they are spread.
    """
    value = -F.col(column) if best_is_low else F.col(column)
    values = users.select(money(value).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("users"))
    shares = [i / RANGES for i in range(1, RANGES)]
    bounds = values.agg(F.struct(F.percentile_approx("value", shares, 10 * RANGES).alias("cuts"), F.sum("users").alias("n"))).scalar()
    cuts, n = bounds.getField("cuts"), bounds.getField("n")
    # the place of a value among the cuts; equal values share theirs
    placed = values.withColumn("range", F.array_position(F.sort_array(F.array_append(cuts, F.col("value"))), F.col("value")))
    within = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    per_range = placed.groupBy("range").agg(F.sum("users").alias("range_users"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    offsets = per_range.select("range", F.coalesce(F.sum("range_users").over(earlier), F.lit(0)).alias("before_range"))
    below = F.col("before_range") + F.coalesce(F.sum("users").over(within), F.lit(0))
    scored = placed.join(offsets, "range").withColumn("below", below)
    score = F.floor(QUINTILES * F.col("below") / n) + 1
    signed = -F.col("value") if best_is_low else F.col("value")
    return scored.select(signed.alias(f"{column}_value"), score.cast("int").alias(f"{column}_score"))


def rfm_label() -> Column:
    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "champion")
        .when((r >= 4) & (f <= 2), "new")
        .when((r <= 2) & (f >= 4), "at risk")
        .when((r <= 2) & (f <= 2), "lapsed")
        .otherwise("regular")
    )


def rfm_segment(users: DataFrame) -> DataFrame:
    """Scores of ``user_id, recency, frequency, monetary`` rows and a label; few days since an order score high.

    The buyers are written once: each score reads them for its values and joins
    them again.
    """
    users = result = materialize(users, "buyers")
    for column, best_is_low in (("recency", True), ("frequency", False), ("monetary", False)):
        scores = _quintile(users, column, best_is_low)
        result = result.join(scores, money(column) == F.col(f"{column}_value")).drop(f"{column}_value")
    return result.withColumn("label", rfm_label())
