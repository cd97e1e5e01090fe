"""Checks that try to refute a diagnosis, its verdict and the next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import any_of
from funnelspark.functions.numeric import safe_divide
from funnelspark.operators.daily import COUNTS
from funnelspark.operators.decompose import decompose_change, summarize_effects
from funnelspark.operators.significance import two_proportion_ztest

# Tolerances and names of the checks.
RECONCILE_TOLERANCE = 0.005
MATERIALITY = 0.0005
PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
CHECKS = ("reconcile", "materiality", "significance", "mix-vs-rate framing", "dollar sanity", "data quality")


def top_driver(default: str = "(none)") -> Column:
    return F.coalesce(F.get("drivers", F.lit(0))["segment"], F.lit(default))


def reconcile_status() -> Column:
    drift = F.abs(F.col("mix") + F.col("rate") + F.col("interaction") - F.col("delta"))
    allowed = F.greatest(RECONCILE_TOLERANCE * F.abs("delta"), F.lit(1e-9))
    return F.when(drift <= allowed, PASS).otherwise(FAIL)


def materiality_status() -> Column:
    return F.when(F.abs("delta") < MATERIALITY, WARN).otherwise(PASS)


def significance_status() -> Column:
    return F.when(F.col("significant"), PASS).otherwise(WARN)


def framing_status() -> Column:
    return F.when(F.col("dominant").isin("mix", "interaction"), WARN).otherwise(PASS)


def dollar_status() -> Column:
    at_risk, ceiling = F.col("revenue_at_risk"), F.col("sessions_t1") * F.col("aov")
    return (
        F.when((F.col("aov") <= 0) | (F.col("sessions_t1") <= 0), FAIL)
        .when(F.abs(at_risk) > ceiling, FAIL)
        .when((F.col("rate") != 0) & ((at_risk > 0) != (F.col("rate") > 0)), WARN)
        .otherwise(PASS)
    )


def funnel_broken(funnel: str) -> Column:
    """A later step holds more sessions than the one before it."""
    return any_of([F.col(f"{funnel}.{b}") > F.col(f"{funnel}.{a}") for a, b in zip(COUNTS, COUNTS[1:])])


def data_quality_status() -> Column:
    outside = ~(F.col("conv_t0").between(0, 1) & F.col("conv_t1").between(0, 1))
    return F.when(outside | funnel_broken("funnel_t0") | funnel_broken("funnel_t1"), FAIL).otherwise(PASS)


def _detail(name: str) -> Column:
    """Short reason of a check that did not pass."""
    if name == "mix-vs-rate framing":
        mix = F.concat(F.lit("mix_only:"), top_driver("none"))
        return F.when(F.col("dominant") == "mix", mix).otherwise("mix_with_rate")
    if name == "data quality":
        return (
            F.when(funnel_broken("funnel_t0"), "funnel_order_t0")
            .when(funnel_broken("funnel_t1"), "funnel_order_t1")
            .otherwise("conversion_range")
        )
    return F.lit({
        "reconcile": "effects_sum",
        "materiality": "small_change",
        "significance": "chance",
        "dollar sanity": "revenue_range",
    }[name])


def critique(diagnoses: DataFrame) -> DataFrame:
    """Adds ``checks``, in a fixed order, and ``verdict``: REFUTE, REVISE or SHIP."""
    statuses = dict(zip(CHECKS, (
        reconcile_status(), materiality_status(), significance_status(),
        framing_status(), dollar_status(), data_quality_status(),
    )))
    checks = F.array(*[
        F.struct(
            F.lit(name).alias("name"), status.alias("status"),
            F.when(status != PASS, _detail(name)).alias("detail"),
        )
        for name, status in statuses.items()
    ])
    return diagnoses.withColumn("checks", checks).withColumn("verdict", verdict())


def verdict(checks: str = "checks") -> Column:
    found = F.col(f"{checks}.status")
    return (
        F.when(F.array_contains(found, FAIL), "REFUTE").when(F.array_contains(found, WARN), "REVISE").otherwise("SHIP")
    )


def recommended_action() -> Column:
    """A code for the next step that fits verdict, significance and dominant effect, with its object after a colon."""
    failed = F.get(F.filter("checks", lambda c: c["status"] == FAIL), F.lit(0))["detail"]
    return (
        F.when(F.col("verdict") == "REFUTE", F.concat(F.lit("repair_data:"), F.coalesce(failed, F.lit("unknown"))))
        .when(~F.col("significant"), F.lit("keep_watching"))
        .when(F.col("dominant") == "mix", F.concat(F.lit("study_mix:"), top_driver("none")))
        .otherwise(F.concat(F.lit("study_rate:"), top_driver("none")))
    )


def ship_gate() -> Column:
    return F.when((F.col("verdict") != "REFUTE") & (F.col("status") == "NEW"), "SHIPPED").otherwise("HELD")


def reconciles(segment_total: Column | str, canonical_total: Column | str, tolerance: float = RECONCILE_TOLERANCE) -> Column:
    """Relative drift within tolerance; a canonical total of 0 is measured against 1."""
    segment_total, canonical_total = (F.col(c) if isinstance(c, str) else c for c in (segment_total, canonical_total))
    base = F.when(F.abs(canonical_total) == 0, F.lit(1.0)).otherwise(F.abs(canonical_total))
    return safe_divide(F.abs(segment_total - canonical_total), base) <= tolerance


def critique_segments(segments: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Verdict on bare segment tables: no money and no funnel, so those two checks stay neutral."""
    effects = decompose_change(segments, by)
    best = F.min(F.struct((-F.abs("total")).alias("rank"), F.col("segment").alias("segment"))).alias("best")
    tops = effects.groupBy(*by).agg(
        best, *[F.sum(c).alias(c) for c in ("num_t0", "den_t0", "num_t1", "den_t1")]
    )
    tested = two_proportion_ztest(tops, "num_t0", "den_t0", "num_t1", "den_t1", alpha)
    sessions_t1 = F.when(F.col("den_t1") > 0, F.col("den_t1")).otherwise(1.0)
    neutral = summarize_effects(effects, by).join(tested, by).select(
        "*",
        F.col("r_t0").alias("conv_t0"), F.col("r_t1").alias("conv_t1"),
        sessions_t1.alias("sessions_t1"), F.lit(1.0).alias("aov"),
        (F.col("rate") * sessions_t1).alias("revenue_at_risk"),
        F.array(F.struct(F.col("best.segment").alias("segment"))).alias("drivers"),
        *[F.struct(*[F.lit(0).alias(c) for c in COUNTS]).alias(f"funnel_t{side}") for side in (0, 1)],
    )
    judged = critique(neutral)
    return judged.select(*by, "delta", "mix", "rate", "interaction", "dominant", "p_value", "significant", "checks", "verdict")
