"""The finding log, recall of many candidates, shards of different schema, and the seed."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from funnelspark.functions.events import channel_group
from funnelspark.operators import memory
from funnelspark.schema import FINDING
from funnelspark.session import materialize
from funnelspark.sources import events, findings
from tests.conftest import rows

D = dt.date


def finding(day, key, w1=1, delta=-0.01):
    return (D(2024, 1, day), D(2024, 1, 1), D(2024, 1, 1 + w1), key, "rate", "s", "down", delta, 1.0, "PASS")


def log_of(spark, *found):
    return spark.createDataFrame(list(found), FINDING)


def test_a_replayed_run_is_in_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert findings.read_runs(spark, path).count() == 0
    first = log_of(spark, finding(3, "a"), finding(3, "a"), finding(4, "b"))
    for _ in range(3):
        findings.append_run(first, path, "r1")
    findings.append_run(log_of(spark, finding(4, "a", delta=0.5)), path, "r2")
    log = findings.read_runs(spark, path)
    assert sorted((r["as_of"].day, r["key"], r["run_id"]) for r in rows(log)) == [(3, "a", "r1"), (4, "a", "r2"), (4, "b", "r1")]
    assert {(r["key"], r["as_of"].day, r["delta"]) for r in rows(findings.latest_findings(log))} == {("a", 4, 0.5), ("b", 4, -0.01)}
    assert [(r["as_of"].day, r["recall_rank"]) for r in rows(memory.recall_order(log).filter("key = 'a'"), "recall_rank")] == [(4, 1), (3, 2)]


def test_the_log_reads_the_days_asked_for(spark, tmp_path):
    path = str(tmp_path / "log")
    findings.append_run(log_of(spark, *(finding(d, "k") for d in range(1, 9))), path, "r")
    window = findings.read_runs(spark, path, D(2024, 1, 3), D(2024, 1, 4))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert window.count() == 2 and "PartitionFilters: [isnotnull(as_of" in plan


def test_many_candidates_find_what_plain_python_finds(spark, monkeypatch):
    monkeypatch.setattr(memory, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(memory, "MEMORY_BLOCK", 40)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(150, 6))
    vectors[20:24] = vectors[5]  # copies tie on one day
    vectors[30] = 0
    day = lambda i: D(2024, 3, 1) - dt.timedelta(days=0 if 20 <= i < 24 else i % 50)
    held = [(i, [float(x) for x in v], day(i)) for i, v in enumerate(vectors)] + [(900, None, D(2024, 1, 1)), (901, [1.0] * 6, None)]
    kind = "vec_id long, embedding array<double>, as_of date"
    asked = [(i, held[i][1], D(2024, 2, 25) + dt.timedelta(days=i % 6)) for i in range(0, 150, 5)] + [(5000, None, D(2024, 1, 1)), (5001, [1.0] * 6, D(1990, 1, 1))]
    got = memory.recall_similar(spark.createDataFrame(held, kind), spark.createDataFrame(asked, kind), k=4)
    want = []
    for i, v, on in asked:
        scored = []
        for j, w, since in held:
            if v and w and since and j != i and since <= on:
                size = math.sqrt(sum(x * x for x in v) * sum(x * x for x in w))
                scored.append((-round(sum(x * y for x, y in zip(v, w)) / size * math.exp(-(on - since).days / 60) if size else 0.0, 9), j))
        want += [(i, n, j) for n, (_, j) in enumerate(sorted(scored)[:4], 1)]
    assert [(r["candidate_id"], r["prior_rank"], r["prior_id"]) for r in rows(got, "candidate_id", "prior_rank")] == sorted(want)
    assert memory.recall_similar(spark.createDataFrame([], kind), spark.createDataFrame(asked, kind)).count() == 0


def test_what_is_merged_is_bounded_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(memory, "MEMORY_BLOCK", 50)
    held = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"), F.lit(D(2024, 1, 1)).alias("as_of"))
    plan = memory.recall_similar(held, held.filter("vec_id < 30"), k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_shards_of_other_schemas_read_as_todays(spark, marts, tmp_path):
    raw = materialize(marts.raw_with_items.filter(F.dayofmonth("event_date").isin(5, 6, 7)), "three-days")
    day = lambda n: raw.filter(F.dayofmonth("event_date") == n).drop("event_date")
    day(5).drop("items", "user_id").withColumn("device", F.struct(F.lit(1).alias("unknown"))).write.parquet(f"{tmp_path}/events_20240105")
    day(6).withColumn("ecommerce", F.col("ecommerce").withField("total_item_quantity", F.col("ecommerce.total_item_quantity").cast("int"))).write.parquet(f"{tmp_path}/events_20240106")
    day(7).withColumn("new_column", F.lit("x")).write.parquet(f"{tmp_path}/events_20240107")
    union = events.read_event_shards(spark, f"{tmp_path}/events_*")
    seen = rows(union.groupBy("event_date").agg(F.count("*").alias("n"), F.count("device.category").alias("devices"), F.count("items").alias("items"), F.sum("ecommerce.total_item_quantity").alias("q")), "event_date")
    expected = rows(raw.groupBy("event_date").agg(F.count("*").alias("n"), F.sum("ecommerce.total_item_quantity").alias("q")), "event_date")
    assert [(r["n"], r["q"]) for r in seen] == [(r["n"], r["q"]) for r in expected]
    assert [r["devices"] for r in seen] == [0, *(r["n"] for r in expected[1:])] and seen[0]["items"] == 0 < seen[2]["items"]
    assert "new_column" not in union.columns
    with pytest.raises(AnalysisException):
        union.select("device.unknown")


def test_the_first_seed_row_that_fits_gives_the_channel(spark, tmp_path):
    path = str(tmp_path / "seed")
    events.write_seed(spark, path, [("google", "cpc", "A"), ("Google", "CPC", "B"), ("google", None, "C"), (None, "cpc", "D"), ("bing", "cpc", "E")])
    asked = spark.createDataFrame([("GOOGLE", "cpc"), ("google", "x"), ("google", None), ("bing", "cpc"), ("y", "z"), (None, None)], "s string, m string")
    got = events.seed_channel(asked, events.read_seed(spark, path), "s", "m")
    assert {(r["s"], r["m"]): r["seed_channel"] for r in rows(got)} == {
        ("GOOGLE", "cpc"): "A", ("google", "x"): "C", ("google", None): "C", ("bing", "cpc"): "D", ("y", "z"): None, (None, None): None}


def test_the_seed_agrees_with_the_channel_rules(spark, tmp_path):
    path = str(tmp_path / "seed")
    events.write_seed(spark, path)
    seed = events.read_seed(spark, path)
    differ = seed.filter(F.col("channel_group") != channel_group("source", "medium", F.lit(None).cast("string")))
    assert seed.count() == 18 and differ.count() == 0
