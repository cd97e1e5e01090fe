"""Benchmark with planted causes: inject, predict, score. All scenarios in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions.numeric import rate_or_zero, safe_divide
from funnelspark.operators.decompose import decompose_change, naive_largest_delta, summarize_effects, top_segment

# Thresholds of the change classifier.
CONTROL_ACTIVITY = 0.04
MIN_CONCENTRATION = 0.30
MIXED_SHARE = 0.35
MOVED = 0.10
FLAT = 0.03
EPSILON = 1e-12
# Floors of the quality gate.
MIN_ACCURACY, MIN_SEGMENT_ACCURACY, MAX_UNKNOWN_SEGMENTS = 0.85, 0.85, 0


@dataclass(frozen=True)
class Scenario:
    """Multipliers of one segment's counts; ``target_rank`` 0 stands for every segment.

    ``cons`` is a companion count that follows genuine changes and stays flat
    when the data, not the behaviour, changed.
    """

    scenario_id: str
    bucket: str
    target_rank: int
    num_mult: float
    den_mult: float
    cons_mult: float
    truth_effect: str

    @classmethod
    def rate(cls, sid: str, rank: int, mult: float, bucket: str = "rate") -> "Scenario":
        return cls(sid, bucket, rank, mult, 1.0, mult, "rate")

    @classmethod
    def mix(cls, sid: str, rank: int, mult: float, bucket: str = "mix") -> "Scenario":
        return cls(sid, bucket, rank, mult, mult, mult, "mix")


# The default benchmark, four rate changes and four mix shifts.
DEFAULT_SCENARIOS = (
    Scenario.rate("rate-1", 1, 0.60), Scenario.rate("rate-2", 2, 0.70),
    Scenario.rate("rate-3", 3, 1.40), Scenario.rate("rate-4", 4, 0.50),
    Scenario.mix("mix-1", 1, 2.00), Scenario.mix("mix-2", 2, 0.40),
    Scenario.mix("mix-3", 3, 1.80), Scenario.mix("mix-4", 4, 0.45),
)


def rank_segments(base: DataFrame, k: int) -> DataFrame:
    """The base table with ``segment_rank`` on its k largest segments, NULL on the rest."""
    top = base.select("segment", "den").orderBy(F.col("den").desc(), "segment").limit(k)
    ranked = top.select("segment", F.row_number().over(Window.orderBy(F.col("den").desc(), "segment")).alias("segment_rank"))
    return base.join(ranked, "segment", "left")


def inject(base: DataFrame, scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS) -> DataFrame:
    """Both periods of every segment under every scenario.

    ``base`` holds ``segment, num, den``. Scenarios are exploded from a literal
    array on each row, so nothing is joined.
    """
    specs = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(Scenario.__dataclass_fields__, astuple(s))]) for s in scenarios
    ])
    ranked = rank_segments(base, max(s.target_rank for s in scenarios))
    crossed = ranked.select("*", F.inline(specs))
    hit = (F.col("target_rank") == 0) | F.coalesce(F.col("target_rank") == F.col("segment_rank"), F.lit(False))

    def after(column: str, mult: str) -> Column:
        return F.col(column).cast("double") * F.when(hit, F.col(mult)).otherwise(1.0)

    return crossed.select(
        "scenario_id", "bucket", "truth_effect", "segment",
        (hit & (F.col("target_rank") > 0)).alias("is_target"),
        F.col("num").cast("double").alias("num_t0"), F.col("den").cast("double").alias("den_t0"),
        F.col("num").cast("double").alias("cons_t0"),
        after("num", "num_mult").alias("num_t1"), after("den", "den_mult").alias("den_t1"),
        after("num", "cons_mult").alias("cons_t1"),
    )


def truth_labels(injected: DataFrame) -> DataFrame:
    return injected.groupBy("scenario_id", "bucket", "truth_effect").agg(
        F.max(F.when(F.col("is_target"), F.col("segment"))).alias("truth_segment")
    )


def score_benchmark(injected: DataFrame) -> DataFrame:
    """Per scenario: predicted segment and effect against the planted ones, next to the naive baseline."""
    by = ["scenario_id"]
    effects = decompose_change(injected, by)
    predicted = top_segment(effects, by).join(summarize_effects(effects, by).select("scenario_id", "dominant"), by)
    joined = truth_labels(injected).join(predicted, by).join(naive_largest_delta(injected, by), by)
    return joined.select(
        "scenario_id", "truth_segment", "truth_effect",
        F.col("top_segment").alias("predicted_segment"), F.col("dominant").alias("predicted_effect"),
        (F.col("top_segment") == F.col("truth_segment")).alias("segment_correct"),
        (F.col("dominant") == F.col("truth_effect")).alias("effect_correct"),
        "naive_segment", (F.col("naive_segment") == F.col("truth_segment")).alias("naive_correct"),
    )


def benchmark_accuracy(scored: DataFrame) -> DataFrame:
    def share(flag: str) -> Column:
        return safe_divide(F.count_if(F.col(flag)), F.count(F.lit(1)))

    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        share("segment_correct").alias("segment_accuracy"),
        share("effect_correct").alias("effect_accuracy"),
        share("naive_correct").alias("naive_accuracy"),
    )


def _moved_by(name: str) -> Column:
    before, after = F.col(f"{name}_t0"), F.col(f"{name}_t1")
    return F.abs(after - before) / F.greatest(F.abs(before), F.lit(EPSILON))


def inconsistent() -> Column:
    """A segment whose counts cannot all be true: one moved while what depends on it did not."""
    held = _moved_by("cons") < FLAT
    return (
        ((_moved_by("num") > MOVED) & held)
        | ((_moved_by("den") > MOVED) & (_moved_by("num") < FLAT) & held)
        | (F.col("num_t1") > F.col("den_t1") * (1 + 1e-6))
    )


def classify_change(segments: DataFrame, by: Sequence[str] = ("scenario_id",)) -> DataFrame:
    """data_quality, none, mixed, rate or mix per comparison, with the segment to blame.

    The cell to blame is the one with the largest sum of absolute effects, which
    opposite signs don't shrink. One aggregation keeps it and the totals.
    """
    by = list(by)
    flagged = segments.withColumn("inconsistent", inconsistent())
    effects = decompose_change(flagged, by, carry=["inconsistent"])
    activity = F.abs("mix") + F.abs("rate") + F.abs("interaction")
    # rounding noise of segments that did not move must not rank them
    effects = effects.withColumn("gross", F.when(activity < EPSILON, 0.0).otherwise(activity))
    top = F.min_by(F.struct("segment", "mix", "rate", "gross", "inconsistent"), F.struct(-F.col("gross"), F.col("segment")))
    per = effects.groupBy(*by).agg(
        top.alias("top"), F.sum("gross").alias("all_gross"), F.sum(F.col("w_t0") * F.col("r_t0")).alias("r_t0")
    )
    total = F.when(F.col("all_gross") == 0, F.lit(EPSILON)).otherwise(F.col("all_gross"))
    m, r = F.abs("top.mix"), F.abs("top.rate")
    effect = (
        F.when(F.col("top.inconsistent"), "data_quality")
        .when(F.col("activity") < CONTROL_ACTIVITY, "none")
        .when(F.col("concentration") < MIN_CONCENTRATION, "none")
        .when(F.least(m, r) >= MIXED_SHARE * F.greatest(m, r, F.lit(EPSILON)), "mixed")
        .when(r >= m, "rate")
        .otherwise("mix")
    )
    measured = per.select(
        *by, "top", (F.col("top.gross") / total).alias("concentration"),
        (total / F.greatest(F.abs("r_t0"), F.lit(EPSILON))).alias("activity"),
    ).withColumn("effect", effect)
    return measured.select(
        *by, "effect", F.when(F.col("effect") != "none", F.col("top.segment")).alias("segment"),
        "concentration", "activity",
    )


def score_predictions(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Joins predictions to labels: artifacts and quiet cases need the effect, the rest the segment too."""
    joined = labels.join(predictions, "scenario_id")
    hit = F.coalesce(F.col("segment") == F.col("truth_segment"), F.lit(False))
    effect = F.col("effect") == F.col("truth_effect")
    correct = F.when(F.col("truth_effect").isin("data_quality", "none"), effect).otherwise(effect & hit)
    return joined.select(
        "scenario_id", "bucket", "truth_effect", "truth_segment", "effect", "segment",
        hit.alias("segment_hit"), correct.alias("correct"),
    )


def accuracy_report(scored: DataFrame) -> DataFrame:
    """Correct and total per bucket, plus the overall row."""
    report = scored.rollup("bucket").agg(
        F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("n"),
        rate_or_zero(F.count_if("correct"), F.count(F.lit(1))).alias("accuracy"),
        F.grouping("bucket").alias("is_total"),
    )
    name = F.when(F.col("is_total") == 1, "(all)").otherwise(F.col("bucket"))
    return report.select(name.alias("bucket"), "correct", "n", "accuracy")


def unknown_segments(predictions: DataFrame, segments: DataFrame) -> DataFrame:
    """Predicted segments that the scenario's own table does not hold."""
    known = segments.select("scenario_id", "segment").distinct()
    return predictions.filter(F.col("segment").isNotNull()).join(known, ["scenario_id", "segment"], "left_anti")


def quality_gate(scored: DataFrame, unknown: DataFrame) -> DataFrame:
    """Overall and top-segment accuracy, unknown segments, and whether all floors hold."""
    with_truth = F.col("truth_segment").isNotNull()
    summary = scored.agg(
        rate_or_zero(F.count_if("correct"), F.count(F.lit(1))).alias("accuracy"),
        F.coalesce(safe_divide(F.count_if(with_truth & F.col("segment_hit")), F.count_if(with_truth)), F.lit(1.0)).alias("segment_accuracy"),
    ).withColumn("unknown_segments", unknown.agg(F.count(F.lit(1))).scalar())
    passed = (
        (F.col("accuracy") >= MIN_ACCURACY) & (F.col("segment_accuracy") >= MIN_SEGMENT_ACCURACY)
        & (F.col("unknown_segments") <= MAX_UNKNOWN_SEGMENTS)
    )
    return summary.withColumn("passed", passed)
