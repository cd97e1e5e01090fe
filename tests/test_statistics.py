import datetime as dt
import random

import pytest

from funnelspark.operators import benchmark, decompose, experiment, series, significance
from funnelspark.operators.benchmark import Scenario
from pyspark.sql import functions as F
from tests.conftest import rows

SEG = "comparison_id string, segment string, num_t0 double, den_t0 double, num_t1 double, den_t1 double"


def summary(df):
    return {r["comparison_id"]: r for r in rows(decompose.summarize_effects(decompose.decompose_change(df)))}


def test_golden_mix_and_rate(spark):
    df = spark.createDataFrame([
        ("mix", "A", 25.0, 500.0, 22.0, 440.0), ("mix", "B", 10.0, 500.0, 11.2, 560.0),
        ("rate", "A", 50.0, 1000.0, 40.0, 1000.0), ("rate", "B", 20.0, 1000.0, 20.0, 1000.0)], SEG)
    got = summary(df)
    assert got["mix"]["mix"] == pytest.approx(-0.0018) and got["mix"]["rate"] == pytest.approx(0, abs=1e-12) and got["mix"]["dominant"] == "mix"
    assert got["rate"]["rate"] == pytest.approx(-0.005) and got["rate"]["mix"] == 0 and got["rate"]["dominant"] == "rate"


def test_effects_add_up_for_random_segments_with_a_hot_comparison(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        d0, d1 = rng.randrange(0, 500), rng.randrange(1, 500)
        data.append(("hot" if i % 3 == 0 else f"c{i % 20}", f"s{i}", float(rng.randrange(0, d0 + 1)), float(d0), float(rng.randrange(0, d1 + 1)), float(d1)))
    for r in summary(spark.createDataFrame(data, SEG)).values():
        assert r["additive"] and r["mix"] + r["rate"] + r["interaction"] == pytest.approx(r["delta"], abs=1e-9)


def test_empty_period_is_an_error(spark):
    df = spark.createDataFrame([("x", "A", 1.0, 10.0, 0.0, 0.0)], SEG)
    assert summary(df)["x"]["error"] == decompose.NO_TOTAL and summary(df)["x"]["mix"] is None
    with pytest.raises(Exception, match=decompose.NO_TOTAL):
        decompose.decompose_change(df, strict=True).collect()


def test_dominant_ties_go_to_mix_then_rate(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, -1.0, 1.0), (0.0, 0.0, 2.0)], "mix double, rate double, interaction double")
    assert [r["d"] for r in rows(df.select(decompose.dominant_effect().alias("d")))] == ["mix", "rate", "interaction"]


def test_two_proportions(spark):
    df = spark.createDataFrame([(500, 10000, 300, 10000), (500, 10000, 498, 10000), (0, 10, 0, 10), (1, 0, 1, 5)], "a long, na long, b long, nb long")
    got = rows(significance.two_proportion_ztest(df, "a", "na", "b", "nb"))
    assert got[0]["p_value"] < 0.001 and got[0]["significant"] and not got[1]["significant"]
    assert (got[2]["z"], got[2]["p_value"]) == (0.0, 1.0) and got[3]["p_value"] is None
    with pytest.raises(Exception, match="empty"):
        significance.two_proportion_ztest(df, "a", "na", "b", "nb", strict=True).collect()


STABLE = [0.0200, 0.0202, 0.0198, 0.0201, 0.0199, 0.0200, 0.0203, 0.0197, 0.0200]


def points(spark, **named):
    data = [(name, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for name, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, "series_id string, t date, value double")


def test_planted_drop_is_the_only_anomaly(spark):
    got = rows(series.detect_anomaly(points(spark, calm=STABLE, drop=[*STABLE, 0.012])), "series_id", "t")
    flagged = [r for r in got if r["is_anomaly"]]
    assert len(flagged) == 1 and flagged[0]["position"] == 9 and flagged[0]["z"] < -2.5
    assert all(r["forecast"] is None and r["z"] == 0 for r in got if r["position"] < 3)


def test_forecast_is_the_mean_of_the_last_points(spark):
    got = rows(series.forecast_next(points(spark, a=STABLE, one=[0.5])), "series_id")
    assert got[0]["forecast"] == pytest.approx(sum(STABLE[-4:]) / 4) and got[0]["low"] < got[0]["forecast"] < got[0]["high"]
    assert got[1]["forecast"] == 0.5 and got[1]["sigma"] == pytest.approx(0.005)


def test_sample_size_and_runtime(spark):
    df = spark.createDataFrame([(0.02, 0.10), (0.0, 0.10), (0.02, 0.0), (0.95, 0.10)], "p double, mde double")
    sized = rows(df.select(experiment.required_sample_size(F.col("p"), F.col("mde")).alias("n"), experiment.sample_size_error(F.col("p"), F.col("mde")).alias("e")))
    assert 78_000 <= sized[0]["n"] <= 86_000 and [r["n"] for r in sized[1:]] == [None] * 3 and all(r["e"] for r in sized[1:])
    days = rows(spark.createDataFrame([(10_000, 1000.0), (10_000, 0.0)], "n long, d double").select(experiment.runtime_days(F.col("n"), F.col("d")).alias("x")))
    assert [r["x"] for r in days] == [20, None]
    with pytest.raises(ValueError):
        experiment.required_sample_size(F.col("p"), F.col("mde"), alpha=1.5)


BASE = [("A", 300, 10000), ("B", 200, 8000), ("C", 90, 5000), ("D", 60, 3000), ("E", 20, 1000), ("F", 5, 500)]


def test_benchmark_recovers_all_planted_causes(spark):
    base = spark.createDataFrame(BASE, "segment string, num long, den long")
    scored = rows(benchmark.score_benchmark(benchmark.inject(base)))
    assert len(scored) == 8 and all(r["segment_correct"] and r["effect_correct"] for r in scored)
    assert {r["naive_segment"] for r in scored if r["truth_effect"] == "mix"} == {decompose.NO_SIGNAL}


def test_classifier_tells_artifacts_from_causes(spark):
    base = spark.createDataFrame(BASE, "segment string, num long, den long")
    cases = [Scenario.rate("r", 1, 0.5), Scenario.mix("m", 1, 2.2), Scenario("d", "dq", 1, 1.0, 1.35, 1.0, "data_quality"),
             Scenario("n", "dq", 1, 0.45, 1.0, 1.0, "data_quality"), Scenario("q", "control", 1, 1.01, 1.0, 1.01, "none"), Scenario("s", "season", 0, 1.3, 1.0, 1.3, "none")]
    injected = benchmark.inject(base, cases)
    predicted = benchmark.classify_change(injected)
    got = {r["scenario_id"]: (r["effect"], r["segment"]) for r in rows(predicted)}
    assert got["r"] == ("rate", "A") and got["m"] == ("mix", "A") and got["q"] == ("none", None)
    assert got["d"][0] == got["n"][0] == "data_quality"
    scored = benchmark.score_predictions(predicted, benchmark.truth_labels(injected))
    gate = rows(benchmark.quality_gate(scored, benchmark.unknown_segments(predicted, injected)))[0]
    assert gate["unknown_segments"] == 0 and 0 <= gate["accuracy"] <= 1
    invented = predicted.withColumn("segment", F.lit("nowhere"))
    assert benchmark.unknown_segments(invented, injected).count() == 6
