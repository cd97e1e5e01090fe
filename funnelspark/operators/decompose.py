"""Why a rate moved: traffic mix, in-segment rate, and their interaction.

Input is one row per comparison and segment with ``num_t0, den_t0, num_t1,
den_t1``; any number of comparisons is handled by the same plan. Totals are
grouped and joined back, never windowed, so one comparison with very many
segments still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions.numeric import rate_or_zero, safe_divide

ADDITIVE_TOLERANCE = 1e-9
NO_TOTAL = "a period has no denominator"
# Fixed value: answer of the naive baseline when no rate moved.
NO_SIGNAL = "(no segment — no rate change detected)"
NAIVE_EPSILON = 1e-9


def decompose_change(
    segments: DataFrame, by: Sequence[str] = ("comparison_id",), strict: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Effects per segment: mix = Δw·r0, rate = w0·Δr, interaction = Δw·Δr.

    A comparison whose total denominator is zero in a period cannot be split:
    its effects are NULL and ``error`` says so, or the job fails when ``strict``.
    ``carry`` names further segment columns to keep.
    """
    by = list(by)
    totals = segments.groupBy(*by).agg(
        F.sum("den_t0").cast("double").alias("all_den_t0"), F.sum("den_t1").cast("double").alias("all_den_t1")
    )
    empty = (F.coalesce("all_den_t0", F.lit(0.0)) == 0) | (F.coalesce("all_den_t1", F.lit(0.0)) == 0)
    error = F.when(empty, F.raise_error(F.lit(NO_TOTAL)) if strict else F.lit(NO_TOTAL))
    shares = segments.join(totals, by).select(
        *by, "segment", *carry, "num_t0", "den_t0", "num_t1", "den_t1",
        "all_den_t1",
        safe_divide("den_t0", "all_den_t0").alias("w_t0"),
        safe_divide("den_t1", "all_den_t1").alias("w_t1"),
        rate_or_zero("num_t0", "den_t0").alias("r_t0"),
        rate_or_zero("num_t1", "den_t1").alias("r_t1"),
        error.alias("error"),
    )
    dw, dr = F.col("w_t1") - F.col("w_t0"), F.col("r_t1") - F.col("r_t0")
    valid = F.col("error").isNull()
    effects = shares.select(
        "*",
        F.when(valid, dw * F.col("r_t0")).alias("mix"),
        F.when(valid, F.col("w_t0") * dr).alias("rate"),
        F.when(valid, dw * dr).alias("interaction"),
    )
    return effects.withColumn("total", F.col("mix") + F.col("rate") + F.col("interaction"))


def dominant_effect(mix: Column | str = "mix", rate: Column | str = "rate", interaction: Column | str = "interaction") -> Column:
    """The largest effect by size; a tie goes to mix, then rate."""
    m, r, i = (F.abs(F.col(c) if isinstance(c, str) else c) for c in (mix, rate, interaction))
    return (
        F.when((m >= r) & (m >= i), "mix").when(r >= i, "rate").when(i.isNotNull(), "interaction")
    )


def is_additive(tolerance: float = ADDITIVE_TOLERANCE) -> Column:
    """The three effects add up to the change."""
    return F.abs(F.col("mix") + F.col("rate") + F.col("interaction") - F.col("delta")) <= tolerance


def summarize_effects(
    effects: DataFrame, by: Sequence[str] = ("comparison_id",), extra: Sequence[Column] = ()
) -> DataFrame:
    """One row per comparison: both rates, the change, its three parts, the dominant one.

    ``extra`` adds aggregates over the same rows.
    """
    summed = effects.groupBy(*by).agg(
        F.sum(F.col("w_t0") * F.col("r_t0")).alias("r_t0"),
        F.sum(F.col("w_t1") * F.col("r_t1")).alias("r_t1"),
        *[F.sum(c).alias(c) for c in ("mix", "rate", "interaction")],
        F.max("error").alias("error"),
        *extra,
    )
    with_delta = summed.withColumn("delta", F.col("r_t1") - F.col("r_t0"))
    return with_delta.select("*", dominant_effect().alias("dominant"), is_additive().alias("additive"))


def top_drivers(effects: DataFrame, by: Sequence[str] = ("comparison_id",), k: int | None = None) -> DataFrame:
    """All segments ranked by total effect, or the first k, to which Spark cuts before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.abs("total").desc(), "segment")
    ranked = effects.withColumn("driver_rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("driver_rank") <= k)


def top_segment(effects: DataFrame, by: Sequence[str] = ("comparison_id",)) -> DataFrame:
    """The first driver per comparison, by aggregation alone."""
    best = F.min_by("segment", F.struct(-F.abs("total"), F.col("segment")))
    return effects.groupBy(*by).agg(best.alias("top_segment"))


def naive_largest_delta(segments: DataFrame, by: Sequence[str] = ("comparison_id",)) -> DataFrame:
    """The segment whose own rate moved most, blind to traffic weights."""
    move = F.abs(rate_or_zero("num_t1", "den_t1") - rate_or_zero("num_t0", "den_t0"))
    best = segments.groupBy(*by).agg(
        F.min(F.struct((-move).alias("negative_move"), F.col("segment"))).alias("best")
    )
    moved = -F.col("best.negative_move") >= NAIVE_EPSILON
    return best.select(*by, F.when(moved, F.col("best.segment")).otherwise(NO_SIGNAL).alias("naive_segment"))
