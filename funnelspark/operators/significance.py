"""Two-sample tests as Column expressions."""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.numeric import safe_divide, two_sided_p


def _beyond(z: str, alpha: float) -> Column:
    """p < alpha, told from z alone: a filter on it stays small wherever it is pushed to."""
    return F.abs(z) > statistics.NormalDist().inv_cdf(1 - alpha / 2)


def two_proportion_ztest(
    df: DataFrame, num_a: str, den_a: str, num_b: str, den_b: str, alpha: float = 0.05, strict: bool = False
) -> DataFrame:
    """Adds ``z, p_value, significant`` of the pooled two-sided test.

    No spread means z = 0 and p = 1. A denominator that is not positive gives
    NULLs, or an error when ``strict``.
    """
    xa, na, xb, nb = (F.col(c).cast("double") for c in (num_a, den_a, num_b, den_b))
    bad = ~F.coalesce((na > 0) & (nb > 0), F.lit(False))
    pooled = safe_divide(xa + xb, na + nb)
    # rounding may push the variance of a rate of 0 or 1 just below zero
    variance = F.greatest(pooled * (1 - pooled), F.lit(0.0)) * (safe_divide(F.lit(1), na) + safe_divide(F.lit(1), nb))
    z = F.coalesce(safe_divide(safe_divide(xb, nb) - safe_divide(xa, na), F.sqrt(variance)), F.lit(0.0))
    invalid = F.raise_error(F.lit("a sample is empty")).cast("double") if strict else F.lit(None).cast("double")
    tested = df.withColumn("z", F.when(bad, invalid).otherwise(z))
    tested = tested.withColumn("p_value", two_sided_p("z"))
    return tested.withColumn("significant", _beyond("z", alpha))


def mean_ztest(
    df: DataFrame, by: list[str], group: str, value: str, a, b, alpha: float = 0.05
) -> DataFrame:
    """Difference of two means per key: effect size, confidence interval, z and p.

    ``group`` tells the samples apart; rows other than ``a`` and ``b`` are left
    out. One aggregation with conditional moments, normal approximation.
    """
    def moments(label, suffix: str) -> list[Column]:
        x = F.when(F.col(group) == label, F.col(value).cast("double"))
        return [
            F.count(x).alias(f"n_{suffix}"), F.avg(x).alias(f"mean_{suffix}"), F.var_samp(x).alias(f"var_{suffix}"),
        ]

    stats = df.filter(F.col(group).isin(a, b)).groupBy(*by).agg(*moments(a, "a"), *moments(b, "b"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    pooled_var = safe_divide((n_a - 1) * F.col("var_a") + (n_b - 1) * F.col("var_b"), n_a + n_b - 2)
    se = F.sqrt(safe_divide("var_a", "n_a") + safe_divide("var_b", "n_b"))
    critical = statistics.NormalDist().inv_cdf(1 - alpha / 2)
    result = (
        stats.withColumn("difference", F.col("mean_b") - F.col("mean_a"))
        .withColumn("effect_size", safe_divide("difference", F.sqrt(pooled_var)))
        .withColumn("se", se)
        .withColumn("z", F.coalesce(safe_divide("difference", "se"), F.when(F.col("se") == 0, 0.0)))
        .withColumn("p_value", two_sided_p("z"))
    )
    return result.select(
        *by, "n_a", "n_b", "mean_a", "mean_b", "difference", "effect_size",
        (F.col("difference") - critical * F.col("se")).alias("ci_low"),
        (F.col("difference") + critical * F.col("se")).alias("ci_high"),
        "z", "p_value", _beyond("z", alpha).alias("significant"),
    )
