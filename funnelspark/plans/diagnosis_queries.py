"""Queries of the statistics, the diagnosis, the verdicts and the benchmark."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import time_grain
from funnelspark.functions.numeric import money_sum, normal_ppf, safe_divide
from funnelspark.operators import benchmark, decompose, diagnosis, experiment, memory, series, significance, verdict
from funnelspark.operators.benchmark import Scenario
from funnelspark.operators.daily import ADDITIVE, base_segments, conversion_series, funnel_counts
from funnelspark.operators.diagnosis import PAIR
from funnelspark.operators.metrics import metric_query
from funnelspark.plans.common import query, report
from funnelspark.plans.marts import Marts
from funnelspark.session import materialize, scratch_path
from funnelspark.sources.findings import append_run, latest_findings, read_runs

# Seasonal calendar of the test data.
CALENDAR_2024 = (
    ("New Year", dt.date(2024, 1, 1), dt.date(2024, 1, 2)),
    ("Sale", dt.date(2024, 1, 15), dt.date(2024, 1, 17)),
)
MEMORY_AS_OF = dt.date(2024, 6, 1)

# Planted causes of every kind the classifier tells apart.
LABELED_SCENARIOS = (
    Scenario.rate("L01", 1, 0.55, "single_segment_rate"), Scenario.rate("L02", 2, 1.60, "single_segment_rate"),
    Scenario.rate("L03", 3, 0.50, "single_segment_rate"),
    Scenario.mix("L04", 1, 2.20, "single_segment_mix"), Scenario.mix("L05", 2, 0.35, "single_segment_mix"),
    Scenario.mix("L06", 3, 2.50, "single_segment_mix"),
    Scenario("L07", "mixed", 1, 3.00, 1.80, 3.00, "mixed"), Scenario("L08", "mixed", 2, 0.30, 0.55, 0.30, "mixed"),
    Scenario("L09", "seasonality_decoy", 0, 1.30, 1.0, 1.30, "none"), Scenario("L10", "seasonality_decoy", 0, 0.75, 1.0, 0.75, "none"),
    Scenario("L11", "no_anomaly_control", 1, 1.01, 1.0, 1.01, "none"), Scenario("L12", "no_anomaly_control", 0, 1.02, 1.02, 1.02, "none"),
    Scenario("L13", "data_quality", 1, 1.0, 1.35, 1.0, "data_quality"), Scenario("L14", "data_quality", 2, 0.45, 1.0, 1.0, "data_quality"),
    Scenario("L15", "data_quality", 0, 0.60, 0.60, 1.0, "data_quality"),
)


def daily_cells(m: Marts) -> DataFrame:
    """The funnel per day, channel and device, with the day in the place of the week."""
    cells = m.funnel.groupBy(F.col("event_date").alias("week"), "channel_group", "device_category").agg(*funnel_counts())
    return materialize(cells.drop("transactions"), "daily-cells")


def weekly_order_series(m: Marts) -> DataFrame:
    """Weekly order value per priority class, years of data."""
    week = time_grain(F.to_date("o_orderdate"), "week").alias("t")
    return m.table("orders").groupBy(F.col("o_orderpriority").alias("series_id"), week).agg(money_sum("o_totalprice").alias("value"))


def daily_conversion(m: Marts) -> DataFrame:
    """Daily conversion per device."""
    return m.funnel.groupBy(F.col("device_category").alias("series_id"), F.col("event_date").alias("t")).agg(
        F.count_if("reached_purchase").alias("num"), F.count(F.lit(1)).alias("den")
    ).select("series_id", "t", safe_divide("num", "den").alias("value"))


def week_pairs(m: Marts) -> DataFrame:
    return diagnosis.adjacent_pairs(m.weekly)


def day_diagnoses(m: Marts) -> DataFrame:
    """Judged diagnoses of all pairs of consecutive days."""
    cells = daily_cells(m)
    return verdict.critique(diagnosis.diagnose(cells, diagnosis.adjacent_pairs(cells)))


# ── statistics ────────────────────────────────────────────────────────────────

@query
def decompose_week_pairs(m: Marts) -> DataFrame:
    return report(decompose.decompose_change(diagnosis.week_segments(m.weekly, week_pairs(m)), PAIR).drop("all_den_t1"))


@query
def decompose_day_pairs(m: Marts) -> DataFrame:
    cells = daily_cells(m)
    segments = diagnosis.week_segments(cells, diagnosis.adjacent_pairs(cells))
    return report(decompose.summarize_effects(decompose.decompose_change(segments, PAIR), PAIR))


@query
def decompose_countries(m: Marts) -> DataFrame:
    weekly = m.funnel.groupBy(time_grain("event_date", "week").alias("week"), "country").agg(*funnel_counts())
    weekly = materialize(weekly, "country-cells")
    segments = diagnosis.week_segments(weekly, diagnosis.adjacent_pairs(weekly), ("country",), "add_to_cart_sessions", "view_item_sessions")
    return report(decompose.decompose_change(segments, PAIR).drop("all_den_t1"))


@query
def dominant_effect(m: Marts) -> DataFrame:
    effects = decompose.decompose_change(diagnosis.week_segments(m.weekly, week_pairs(m)), PAIR)
    return report(decompose.summarize_effects(effects, PAIR))


@query
def naive_baseline(m: Marts) -> DataFrame:
    return decompose.naive_largest_delta(diagnosis.week_segments(m.weekly, week_pairs(m)), PAIR)


@query
def ztest_week_pairs(m: Marts) -> DataFrame:
    totals = diagnosis.pair_totals(m.weekly, week_pairs(m))
    tested = significance.two_proportion_ztest(totals, "purchasing_sessions_t0", "sessions_t0", "purchasing_sessions_t1", "sessions_t1")
    return report(tested, *PAIR, "z", "p_value", "significant")


@query
def ztest_segments(m: Marts) -> DataFrame:
    cells = daily_cells(m)
    segments = diagnosis.week_segments(cells, diagnosis.adjacent_pairs(cells), ("channel_group",), "add_to_cart_sessions")
    tested = significance.two_proportion_ztest(segments, "num_t0", "den_t0", "num_t1", "den_t1")
    return report(tested, *PAIR, "segment", "z", "p_value", "significant")


@query
def mean_test(m: Marts) -> DataFrame:
    orders = m.table("orders")
    return report(significance.mean_ztest(orders, ["o_orderpriority"], "o_orderstatus", "o_totalprice", "F", "O"), digits=5)


@query
def normal_quantiles(m: Marts) -> DataFrame:
    ratio = m.table("part").select(F.col("p_partkey"), ((F.col("p_partkey") % 997 + 1) / 1000.0).alias("p"))
    return report(ratio.withColumn("z", normal_ppf("p")), digits=7)


@query
def anomaly_weekly(m: Marts) -> DataFrame:
    return report(series.detect_anomaly(weekly_order_series(m)), "series_id", "t", "value", "position", "forecast", "sigma", "z", "is_anomaly", digits=4)


@query
def anomaly_daily(m: Marts) -> DataFrame:
    return report(series.detect_anomaly(daily_conversion(m)))


@query
def forecast_next(m: Marts) -> DataFrame:
    return report(series.forecast_next(weekly_order_series(m)), digits=4)


@query
def forecast_conversion(m: Marts) -> DataFrame:
    return report(series.forecast_next(daily_conversion(m)))


@query
def iqr_anomaly(m: Marts) -> DataFrame:
    return report(series.iqr_anomaly(weekly_order_series(m)), digits=4)


@query
def ewma_anomaly(m: Marts) -> DataFrame:
    return report(series.ewma_anomaly(daily_conversion(m)), digits=6)


@query
def seasonal_residual(m: Marts) -> DataFrame:
    return report(series.seasonal_residual(daily_conversion(m)), digits=6)


@query
def weekly_conversion(m: Marts) -> DataFrame:
    return report(conversion_series(m.weekly))


# ── diagnosis ─────────────────────────────────────────────────────────────────

@query
def adjacent_pairs(m: Marts) -> DataFrame:
    return report(week_pairs(m))


@query
def biggest_move(m: Marts) -> DataFrame:
    return diagnosis.select_move(m.weekly, "delta")


@query
def anomalous_move(m: Marts) -> DataFrame:
    return diagnosis.select_move(daily_cells(m), "anomaly")


DIAGNOSIS_COLUMNS = (
    *PAIR, "conv_t0", "conv_t1", "delta", "mix", "rate", "interaction", "dominant", "p_value", "significant",
    "sessions_t1", "aov", "revenue_at_risk",
)


@query
def diagnosis_weeks(m: Marts) -> DataFrame:
    return report(diagnosis.diagnose(m.weekly, week_pairs(m)), *DIAGNOSIS_COLUMNS, digits=6)


@query
def diagnosis_of_biggest_move(m: Marts) -> DataFrame:
    return report(diagnosis.diagnose(m.weekly, diagnosis.select_move(m.weekly, "delta")), *DIAGNOSIS_COLUMNS, digits=6)


@query
def diagnosis_days(m: Marts) -> DataFrame:
    return report(day_diagnoses(m), *DIAGNOSIS_COLUMNS, "verdict", digits=6)


@query
def top_drivers(m: Marts) -> DataFrame:
    found = diagnosis.diagnose(m.weekly, week_pairs(m)).select(*PAIR, F.inline("drivers"))
    return report(found, digits=6)


@query
def funnel_totals(m: Marts) -> DataFrame:
    found = diagnosis.diagnose(m.weekly, week_pairs(m))
    t0 = found.select("w0", "w1", F.lit(0).alias("side"), "funnel_t0.*")
    t1 = found.select("w0", "w1", F.lit(1).alias("side"), "funnel_t1.*")
    return report(t0.unionByName(t1))


@query
def revenue_at_risk(m: Marts) -> DataFrame:
    found = diagnosis.diagnose(m.weekly, week_pairs(m))
    return report(found, *PAIR, "rate", "sessions_t1", "aov", "revenue_at_risk", digits=6)


@query
def critic_verdict(m: Marts) -> DataFrame:
    judged = day_diagnoses(m)
    checks = judged.select(*PAIR, "verdict", F.inline("checks")).select(*PAIR, "verdict", "name", "status")
    return checks


@query
def critique_segments(m: Marts) -> DataFrame:
    cells = daily_cells(m)
    segments = diagnosis.week_segments(cells, diagnosis.adjacent_pairs(cells))
    judged = verdict.critique_segments(segments, list(PAIR))
    return report(judged.withColumn("statuses", F.concat_ws(",", "checks.status")).drop("checks"))


@query
def recommended_action(m: Marts) -> DataFrame:
    return day_diagnoses(m).select(*PAIR, verdict.recommended_action().alias("action"))


@query
def identity_check(m: Marts) -> DataFrame:
    m.share_sessions()
    funnel = metric_query(
        m, ["sessions", "view_item_sessions", "add_to_cart_sessions", "begin_checkout_sessions", "purchasing_sessions", "revenue"],
        ["week"], order_by_time=False,
    )
    orders = metric_query(m, ["orders", "gross_revenue"], ["week"], order_by_time=False)
    return report(diagnosis.identity_check(funnel.join(orders, "week", "left")))


@query
def reconcile_totals(m: Marts) -> DataFrame:
    """Totals of the weekly cells against the session facts, one row per measure."""
    m.share_sessions()
    weekly = m.weekly.agg(F.sum("sessions").alias("sessions"), F.sum("purchasing_sessions").alias("purchasing_sessions"), money_sum("revenue").alias("revenue"))
    canonical = metric_query(m, ["sessions", "purchasing_sessions", "revenue"])
    rows = weekly.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("segment_total"), canonical.select(F.col(c).cast("double")).scalar().alias("canonical_total"))
        for c in ("sessions", "purchasing_sessions", "revenue")
    ])))
    return report(rows.withColumn("reconciles", verdict.reconciles("segment_total", "canonical_total")))


@query
def drill_tree(m: Marts) -> DataFrame:
    dims = ("channel_group", "device_category", "landing_page")
    cells = m.funnel.groupBy(time_grain("event_date", "week").alias("week"), *dims).agg(*funnel_counts())
    cells = materialize(cells, "drill-cells")
    tree = diagnosis.drill_tree(cells, diagnosis.adjacent_pairs(cells), dims, min_sessions=5, min_rate_effect=0.0005, alpha=0.25)
    return report(tree, *PAIR, "depth", "parent", "node", "node_rank", "den_t1", "r_t0", "r_t1", "mix", "rate", "interaction", "p_value")


@query
def drill_leaves(m: Marts) -> DataFrame:
    """The search at its documented bounds: why did the share of returned lines move between two years of all orders?

    A line counts as a session and a returned one as a purchase of its price.
    """
    dims = ("l_linestatus", "region", "o_orderpriority")
    lines = m.table("lineitem").join(m.table("orders"), F.expr("l_orderkey = o_orderkey")).join(m.table("customer"), F.expr("o_custkey = c_custkey"))
    lines = lines.join(m.table("nation"), F.expr("c_nationkey = n_nationkey")).join(m.table("region"), F.expr("n_regionkey = r_regionkey"))
    returned = F.col("l_returnflag") == "R"
    measures = (
        F.count(F.lit(1)).alias("sessions"), F.count_if(returned).alias("purchasing_sessions"),
        money_sum(F.when(returned, F.col("l_extendedprice")).otherwise(0.0)).alias("revenue"),
    )
    year = F.to_date(F.trunc(F.to_date("l_shipdate"), "year")).alias("year")
    cells = materialize(lines.groupBy(year, "l_linestatus", F.col("r_name").alias("region"), "o_orderpriority").agg(*measures), "drill-cells")
    years = cells.agg(F.collect_set("year").alias("ys"))  # calendar years
    pairs = years.selectExpr("inline(flatten(transform(ys, a -> transform(filter(ys, b -> b > a), b -> struct(a AS w0, b AS w1)))))")
    canonical = m.table("lineitem").groupBy(year).agg(*measures)
    tree = diagnosis.drill_tree(cells, pairs, dims, period="year", canonical=canonical, min_revenue=1000.0)
    return report(tree)


# ── memory, suppression, experiments ──────────────────────────────────────────

@query
def seasonal_overlap(m: Marts) -> DataFrame:
    weeks = m.funnel.select(time_grain("event_date", "week").alias("week"), F.col("event_date").alias("day")).distinct()
    calendar = memory.seasonal_calendar(m.spark, CALENDAR_2024)
    by_week = memory.event_for_week(weeks, "week", calendar).withColumnRenamed("season", "week_season")
    return memory.event_on(by_week, "day", calendar).withColumnRenamed("season", "day_season")


@query
def findings_log(m: Marts) -> DataFrame:
    return report(memory.to_findings(day_diagnoses(m), F.date_add("w1", 1)), digits=6)


@query
def suppression(m: Marts) -> DataFrame:
    """Every weekly diagnosis judged two weeks later, against a log of the falling ones a week earlier."""
    judged = materialize(verdict.critique(diagnosis.diagnose(m.weekly, week_pairs(m))), "judged")
    log = memory.to_findings(judged.filter("delta < 0"), F.date_add("w1", 7))
    decided = memory.suppress(judged, log, memory.seasonal_calendar(m.spark, CALENDAR_2024), F.date_add("w1", 14))
    return decided.select(*PAIR, "key", "season", "prior_as_of", "verdict", "status", "suppressed", verdict.ship_gate().alias("gate"))


@query
def suppression_days(m: Marts) -> DataFrame:
    """The same for days: a log of all findings, each asked for again the day after it was written."""
    judged = materialize(day_diagnoses(m), "judged")
    log = memory.to_findings(judged.filter(F.dayofmonth("w1") % 2 == 0), "w1")
    decided = memory.suppress(judged, log, memory.seasonal_calendar(m.spark, CALENDAR_2024[:1]), F.date_add("w1", 1))
    return decided.select(*PAIR, "key", "season", "prior_as_of", "verdict", "status", "suppressed", verdict.ship_gate().alias("gate"))


@query
def recall_prior(m: Marts) -> DataFrame:
    """For each finding of a day the latest earlier one with the same key in the 14 days before."""
    log = materialize(memory.to_findings(day_diagnoses(m), "w1"), "findings")
    asked = log.select("key", "w0", "w1", F.date_sub("as_of", 1).alias("asked_on"))
    return memory.latest_prior(asked, log, memory.REPEAT_WINDOW_DAYS, as_of="asked_on")


def logged_twice(m: Marts) -> str:
    """A log of two runs over the findings of all days, the second of them replayed; returns its path."""
    found = materialize(memory.to_findings(day_diagnoses(m), "w1"), "findings")
    path = scratch_path(m.spark, "finding-log")
    even = F.dayofmonth("w1") % 2 == 0
    append_run(found.filter(~even), path, "odd")
    for _ in range(2):
        append_run(found.filter(even).unionByName(found.filter(even)), path, "even")
    return path


@query
def finding_log_recall(m: Marts) -> DataFrame:
    """The log read back, findings of each key numbered from the newest."""
    recalled = memory.recall_order(read_runs(m.spark, logged_twice(m)))
    return report(recalled, "run_id", "recall_rank", "as_of", *PAIR, "key", "direction", "delta", "verdict", digits=6)


@query
def finding_log_latest(m: Marts) -> DataFrame:
    """The newest finding of each key in a window of days."""
    window = read_runs(m.spark, logged_twice(m), dt.date(2024, 1, 8), dt.date(2024, 1, 25))
    return report(latest_findings(window), "run_id", "as_of", *PAIR, "key", "delta", digits=6)


@query
def weeks(m: Marts) -> DataFrame:
    """Weeks of the funnel in order."""
    return m.weekly.select("week").distinct().orderBy("week")


@query
def acknowledged(m: Marts) -> DataFrame:
    """Top driver of each pair of days without those on an unexpired suppression list."""
    tops = materialize(day_diagnoses(m).select(
        F.lit("session_conversion_rate").alias("metric"), verdict.top_driver().alias("dimension_slice"),
        F.col("dominant").alias("root_cause_label"), "w1",
    ), "candidates")
    listed = tops.filter(F.dayofmonth("w1") % 3 == 0).select(
        "metric", "dimension_slice", "root_cause_label", F.date_add("w1", 10).alias("expires_at")
    )
    return memory.drop_acknowledged(tops, listed, dt.date(2024, 1, 25))


@query
def similar_findings(m: Marts) -> DataFrame:
    remembered = m.table("embeddings").select(
        "vec_id", "label", "embedding", F.date_sub(F.lit(MEMORY_AS_OF), (F.col("vec_id") % 180).cast("int")).alias("as_of")
    )
    candidate = m.table("embeddings").agg(F.min_by("embedding", "vec_id")).scalar()
    return report(memory.similar_findings(remembered, candidate, MEMORY_AS_OF), digits=6)


@query
def recall_similar(m: Marts) -> DataFrame:
    """All findings of a run at once: every twentieth vector asked for, as of a day of its own, against all."""
    remembered = m.table("embeddings").select("vec_id", "embedding", F.date_sub(F.lit(MEMORY_AS_OF), (F.col("vec_id") % 180).cast("int")).alias("as_of"))
    asked = remembered.filter("vec_id % 20 = 0").withColumn("as_of", F.date_sub(F.lit(MEMORY_AS_OF), (F.col("vec_id") % 7).cast("int")))
    return report(memory.recall_similar(remembered, asked), digits=6)


@query
def sample_size(m: Marts) -> DataFrame:
    segments = base_segments(m.weekly).withColumn("baseline_rate", safe_divide("num", "den"))
    baseline, mde = F.col("baseline_rate"), F.lit(0.10)
    sized = segments.select(
        "segment", "baseline_rate",
        experiment.required_sample_size(baseline, mde).alias("n_per_arm"),
        experiment.sample_size_error(baseline, mde).alias("error"),
    )
    return report(sized)


DESIGN_COLUMNS = ("segment", "baseline_rate", "daily_eligible_sessions", "n_per_arm", "total_n", "runtime_days", "runtime_weeks", "feasible", "split")


@query
def experiment_design(m: Marts) -> DataFrame:
    segments = base_segments(m.weekly).select(
        "segment", safe_divide("num", "den").alias("baseline_rate"), (F.col("den") / 30).alias("daily_eligible_sessions")
    )
    return report(experiment.design_experiments(segments, mde_rel=0.10), *DESIGN_COLUMNS)


@query
def recommended_experiment(m: Marts) -> DataFrame:
    population = experiment.experiment_population(day_diagnoses(m))
    return report(experiment.design_experiments(population, mde_rel=0.10), *PAIR, *DESIGN_COLUMNS)


@query
def ice_backlog(m: Marts) -> DataFrame:
    cards = day_diagnoses(m).select(
        *PAIR, "revenue_at_risk", F.lit(0.10).alias("expected_lift"),
        (1 - F.col("p_value")).alias("confidence"), F.when(F.col("dominant") == "rate", 1.0).otherwise(0.5).alias("ease"),
    )
    return report(experiment.rank_backlog(cards), digits=6)


# ── benchmark ─────────────────────────────────────────────────────────────────

def injected(m: Marts, scenarios=benchmark.DEFAULT_SCENARIOS) -> DataFrame:
    return materialize(benchmark.inject(base_segments(m.weekly), scenarios), "scenarios")


@query
def inject_benchmark(m: Marts) -> DataFrame:
    return report(benchmark.inject(base_segments(m.weekly)))


@query
def benchmark_scores(m: Marts) -> DataFrame:
    return benchmark.score_benchmark(injected(m))


@query
def benchmark_accuracy(m: Marts) -> DataFrame:
    return report(benchmark.benchmark_accuracy(benchmark.score_benchmark(injected(m))))


@query
def classify_change(m: Marts) -> DataFrame:
    return report(benchmark.classify_change(injected(m, LABELED_SCENARIOS)))


@query
def labeled_accuracy(m: Marts) -> DataFrame:
    segments = injected(m, LABELED_SCENARIOS)
    scored = benchmark.score_predictions(benchmark.classify_change(segments), benchmark.truth_labels(segments))
    return report(benchmark.accuracy_report(scored))


@query
def quality_gate(m: Marts) -> DataFrame:
    segments = injected(m, LABELED_SCENARIOS)
    predictions = benchmark.classify_change(segments)
    scored = benchmark.score_predictions(predictions, benchmark.truth_labels(segments))
    return report(benchmark.quality_gate(scored, benchmark.unknown_segments(predictions, segments)))
