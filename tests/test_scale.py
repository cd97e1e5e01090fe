"""What has to hold when the data grow: no cuts, no quadratic folds, no unpruned scans, no gathering ranges."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from funnelspark.operators import experiment, metrics, rfm, series
from funnelspark.operators.decompose import top_drivers
from funnelspark.operators.metrics import SemanticError, metric_query
from funnelspark.plans.marts import Marts, StoredMarts, build_marts
from funnelspark.sources.events import read_event_shards
from funnelspark.sources.testtables import raw_events
from tests.conftest import SF


def test_items_come_from_all_parts(spark):
    items = raw_events(spark, SF, items=True).select(F.explode("items").alias("i")).select(F.col("i.item_id").cast("long").alias("p"))
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    low, high, n = items.agg(F.min("p"), F.max("p"), F.countDistinct("p")).first()
    assert low < 0.1 * parts and high > 0.9 * parts and n > 0.5 * parts


def test_all_cells_of_a_device_are_pooled(spark):
    drivers = [{"driver_rank": i + 1, "segment": f"channel{i} / mobile", "sessions_t1": 10, "conv_t1_pct": 10.0} for i in range(10)]
    kind = "w0 int, w1 int, verdict string, dominant string, drivers array<struct<driver_rank:int,segment:string,sessions_t1:long,conv_t1_pct:double>>"
    judged = spark.createDataFrame([(1, 2, "CONFIRM", "rate", drivers)], kind)
    row = experiment.experiment_population(judged).first()
    assert row.segment == "mobile" and abs(row.daily_eligible_sessions - 100 / 7) < 1e-9


def test_drivers_are_complete_unless_cut(spark):
    effects = spark.createDataFrame([("c", f"s{i}", float(i)) for i in range(20)], "comparison_id string, segment string, total double")
    assert top_drivers(effects).count() == 20 and top_drivers(effects, k=3).count() == 3


def test_one_large_buyer_leaves_the_ranges_even(spark):
    users = spark.range(1, 4001).select("id", F.lit(1).alias("recency"), F.lit(1).alias("frequency"), F.when(F.col("id") == 4000, 1e12).otherwise(F.col("id").cast("double")).alias("monetary"))
    scores = rfm._quintile(users, "monetary", best_is_low=False)
    assert [r["n"] for r in scores.groupBy("monetary_score").agg(F.count("*").alias("n")).orderBy("monetary_score").collect()] == [800] * 5
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan


def test_levels_of_a_long_series_equal_the_recursion(spark):
    n = 10_000
    values = [float((i * 7919) % 101) for i in range(n)]
    points = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "series_id string, t int, value double")
    got = [r.level for r in series.ewma_anomaly(points, alpha=0.3).orderBy("t").collect()]
    level, want = None, []
    for v in values:
        want.append(level)
        level = v if level is None else 0.3 * v + 0.7 * level
    assert got[0] is None and all(abs(a - b) < 1e-9 for a, b in zip(got[1:], want[1:]))


def test_a_window_over_shards_reads_its_shards_only(spark, tmp_path):
    events = raw_events(spark, SF).filter(F.col("event_date") <= dt.date(2024, 1, 3))
    for day in (1, 2, 3):
        events.filter(F.col("event_date") == dt.date(2024, 1, day)).drop("event_date").write.parquet(f"{tmp_path}/events_2024010{day}")
    one = read_event_shards(spark, f"{tmp_path}/events_*", dt.date(2024, 1, 2), dt.date(2024, 1, 2))
    assert one.count() == events.filter(F.col("event_date") == dt.date(2024, 1, 2)).count() > 0
    read = {re.search(r"events_(\d+)", r[0])[1] for r in one.select(F.input_file_name()).distinct().collect()}
    assert read == {"20240102"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "_metadata" in plan or "file_path" in plan



def test_filter_values_take_the_type_of_their_dimension(marts):
    none = metric_query(marts, ["sessions"], [], [{"dimension": "campaign", "op": "=", "value": "2024-01-05"}, {"dimension": "source", "op": "!=", "value": "sale-ab-cd"}])
    assert none.first()["sessions"] in (0, None)
    with pytest.raises(SemanticError):
        metric_query(marts, ["sessions"], [], [{"dimension": "day", "op": "=", "value": "sale-ab-cd"}])
    assert metrics.Filter("day", "=", "2024-01-05").condition() is not None


def test_requests_on_stored_marts_scan_no_raw_event(spark, tmp_path):
    stored = build_marts(Marts(spark, SF), str(tmp_path), ("fct_funnel", "fct_orders"))
    result = metric_query(StoredMarts(spark, str(tmp_path), ("fct_funnel", "fct_orders")), ["sessions"], ["day"])
    assert all(str(tmp_path) in f for f in result.inputFiles())
    assert sum(r["sessions"] for r in result.collect()) == stored["fct_funnel"].count()
