"""Sizing of follow-up experiments."""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.numeric import safe_divide

# Metrics that must not suffer, default sizing, longest feasible test.
GUARDRAILS = ("aov", "cart_abandonment_rate", "net_revenue")
ALPHA, POWER, ARMS = 0.05, 0.80, 2
MAX_RUNTIME_DAYS = 42


def _check_test(alpha: float, power: float) -> None:
    if not (0 < alpha < 1 and 0 < power < 1):
        raise ValueError("alpha and power must lie between 0 and 1")


def sample_size_error(baseline: Column, mde_rel: Column) -> Column:
    """Reason why a test cannot be sized, else NULL."""
    lifted = baseline * (1 + mde_rel)
    return (
        F.when(~F.coalesce((baseline > 0) & (baseline < 1), F.lit(False)), "baseline must lie between 0 and 1")
        .when(mde_rel == 0, "the effect must not be 0")
        .when(~F.coalesce((lifted > 0) & (lifted < 1), F.lit(False)), "the lifted rate must lie between 0 and 1")
    )


def required_sample_size(baseline: Column, mde_rel: Column, alpha: float = ALPHA, power: float = POWER) -> Column:
    """Sessions per arm to detect a relative change of a rate, two-sided; NULL when it cannot be sized."""
    _check_test(alpha, power)
    z_alpha = statistics.NormalDist().inv_cdf(1 - alpha / 2)
    z_power = statistics.NormalDist().inv_cdf(power)
    p1, p2 = baseline, baseline * (1 + mde_rel)
    middle = (p1 + p2) / 2
    spread = z_alpha * F.sqrt(2 * middle * (1 - middle)) + z_power * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    size = F.ceil(safe_divide(spread * spread, (p2 - p1) * (p2 - p1)))
    return F.when(sample_size_error(baseline, mde_rel).isNull(), size)


def runtime_days(n_per_arm: Column, daily: Column, arms: int = ARMS) -> Column:
    """Days until all arms are filled; NULL without traffic."""
    return F.when(daily > 0, F.ceil(safe_divide(n_per_arm * arms, daily)))


def design_experiments(
    segments: DataFrame, mde_rel: float = 0.05, alpha: float = ALPHA, power: float = POWER, arms: int = ARMS,
    primary_metric: str = "session_conversion_rate", max_runtime_days: int = MAX_RUNTIME_DAYS,
) -> DataFrame:
    """Adds the design to rows of ``segment, baseline_rate, daily_eligible_sessions``."""
    baseline, mde = F.col("baseline_rate"), F.lit(mde_rel)
    sized = (
        segments.withColumn("error", sample_size_error(baseline, mde))
        .withColumn("n_per_arm", required_sample_size(baseline, mde, alpha, power))
        .withColumn("total_n", F.col("n_per_arm") * arms)
        .withColumn("runtime_days", runtime_days(F.col("n_per_arm"), F.col("daily_eligible_sessions"), arms))
    )
    split = "/".join(["50"] * arms) if arms == 2 else f"{round(100 / arms)}% x {arms}"
    return sized.select(
        "*",
        F.bround(F.col("runtime_days") / 7, 1).alias("runtime_weeks"),
        F.coalesce(F.col("runtime_days") <= max_runtime_days, F.lit(False)).alias("feasible"),
        F.lit(split).alias("split"),
        F.lit(primary_metric).alias("primary_metric"),
        F.array(*[F.lit(g) for g in GUARDRAILS]).alias("guardrails"),
        F.lit(mde_rel).alias("mde_rel"), F.lit(alpha).alias("alpha"), F.lit(power).alias("power"), F.lit(arms).alias("arms"),
    )


def experiment_population(judged: DataFrame) -> DataFrame:
    """Baseline and traffic of the population to test, for rate findings that were not refuted.

    All segments that share the top driver's device are pooled, weighted by their
    traffic of the compare week. A diagnosis has an entry for each segment, so this
    is array work on one row.
    """
    def device(segment: Column) -> Column:
        return F.element_at(F.split(segment, " / "), -1)

    top = F.get("drivers", F.lit(0))["segment"]
    pool = F.filter("drivers", lambda d: (device(d["segment"]) == device(top)) & (d["sessions_t1"] > 0))
    candidates = judged.filter((F.col("verdict") != "REFUTE") & (F.col("dominant") == "rate")).withColumn("pool", pool)
    traffic = F.aggregate("pool", F.lit(0).cast("long"), lambda total, d: total + d["sessions_t1"])
    converted = F.aggregate("pool", F.lit(0.0), lambda total, d: total + d["conv_t1_pct"] / 100 * d["sessions_t1"])
    pooled = candidates.select(
        "w0", "w1", F.when(F.size("pool") > 1, device(top)).otherwise(top).alias("segment"),
        traffic.alias("weekly_sessions"), converted.alias("converted"),
    ).filter(F.col("weekly_sessions") > 0)
    return pooled.select(
        "w0", "w1", "segment", safe_divide("converted", "weekly_sessions").alias("baseline_rate"),
        (F.col("weekly_sessions") / 7).alias("daily_eligible_sessions"),
    )


def rank_backlog(cards: DataFrame) -> DataFrame:
    """Orders cards by ICE = impact x confidence x ease, with impact = |revenue at risk| x expected lift."""
    impact = F.abs(F.col("revenue_at_risk")) * F.col("expected_lift")
    scored = cards.withColumn("ice", impact * F.col("confidence") * F.col("ease"))
    return scored.orderBy(F.col("ice").desc())
