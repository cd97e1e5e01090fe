import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from funnelspark.functions.events import REACHED, event_param
from funnelspark.operators.staging import stg_events
from funnelspark.session import materialize
from funnelspark.sources import daytable, events, marts as sinks
from funnelspark.sources.daytable import DayTable
from funnelspark.streaming import daily_funnel, session_state
from tests.conftest import SF, rows


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    from funnelspark.sources.testtables import raw_events

    path = str(tmp_path_factory.mktemp("raw") / "events")
    sinks.write_mart(raw_events(spark, SF), path, partition_by="event_date")
    return path


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_prunes_partitions_and_columns(spark, landing):
    df = events.read_events(spark, landing, start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 6)).select("event_date", event_param("ga_session_id", "int").alias("sid"))
    plan = executed(df)
    assert "PartitionFilters: [isnotnull(event_date" in plan
    schema = plan[plan.index("ReadSchema"):]
    assert "int_value" in schema and "string_value" not in schema and "traffic_source" not in schema
    assert [r["event_date"].day for r in rows(df.select("event_date").distinct(), "event_date")] == [5, 6]


def test_default_window_holds_no_test_event(spark, landing):
    assert events.read_events_default_window(spark, landing).count() == 0


def test_day_shards_are_one_table(spark, landing, tmp_path):
    day = events.read_events(spark, landing).drop("event_date", "items")
    for name in ("20240105", "20240106"):
        date = dt.datetime.strptime(name, "%Y%m%d").date()
        events.read_events(spark, landing, start=date, end=date).drop("event_date").write.parquet(f"{tmp_path}/events_{name}")
    union = events.read_event_shards(spark, f"{tmp_path}/events_*", end=dt.date(2024, 1, 6))
    expected = events.read_events(spark, landing, start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 6))
    assert rows(union.groupBy("event_date").count(), "event_date") == rows(expected.groupBy("event_date").count(), "event_date")
    assert "event_name" in day.columns


def test_seed_is_text(spark, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text("source,medium,channel_group\n(direct),(none),Direct\n007,cpc,Other\n")
    assert rows(events.read_seed(spark, str(path)), "source")[1]["source"] == "007"


def test_upsert_replaces_only_its_days_and_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "mart")
    table = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 3)], "event_date date, n int")
    sinks.write_mart(table, path, partition_by="event_date")
    patch = spark.createDataFrame([(dt.date(2024, 1, 2), 20), (dt.date(2024, 1, 4), 4)], "event_date date, n int")
    for _ in range(2):
        sinks.upsert_partitions(patch, path)
        assert [r["n"] for r in rows(sinks.read_mart(spark, path), "event_date")] == [1, 20, 3, 4]


def same(got, expected):
    got = got.select(*expected.columns)
    return got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_an_event_of_thirty_days_ago_changes_its_day_and_neighbours(spark, landing, tmp_path):
    raw = events.read_events(spark, landing)
    late = (F.col("event_date") == F.lit(dt.date(2024, 1, 2))) & (F.col("event_timestamp") % 2 == 0)
    place, mart = str(tmp_path / "raw"), str(tmp_path / "daily")
    raw.filter(~late).write.partitionBy("event_date").parquet(place)
    assert len(daily_funnel.refresh_changed(spark, place, mart)) == 30
    before = materialize(DayTable(spark, mart).read(), "before")
    assert daily_funnel.refresh_changed(spark, place, mart) == []
    raw.filter(late).write.mode("append").partitionBy("event_date").parquet(place)
    assert [r["event_date"].day for r in rows(daily_funnel.late_events(spark, place, mart))] == [2]
    assert daily_funnel.refresh_changed(spark, place, mart) == [dt.date(2024, 1, d) for d in (1, 2, 3)]
    assert daily_funnel.late_events(spark, place, mart).count() == 0
    after = DayTable(spark, mart).read()
    assert same(after, daily_funnel.daily_from_raw(raw))
    assert {r["event_date"].day for r in after.exceptAll(before).select("event_date").collect()} == {2}


def test_a_commit_replaces_and_empties_days_at_once(spark, tmp_path, monkeypatch):
    table = DayTable(spark, str(tmp_path / "t"))
    day = lambda d: dt.date(2024, 1, d)
    frame = lambda *ds: spark.createDataFrame([(day(d), n) for d, n in ds], "event_date date, n long")
    held = lambda: [(r["event_date"].day, r["n"]) for r in rows(table.read(), "event_date", "n")]
    with pytest.raises(ValueError):
        table.read()
    assert table.commit(frame((1, 1), (2, 2), (3, 3)), run="a")
    patch, days = frame((3, 2), (3, 30)), [day(2), day(3), day(9)]
    manifest = table._manifest()
    with monkeypatch.context() as patched:
        patched.setattr(DayTable, "_manifest", lambda self: manifest)
        patched.setattr(daytable, "MANIFEST", "broken")  # fails between the rows and the manifest
        with pytest.raises(ParseException):
            table.commit(patch, days, run="b")
    assert held() == [(1, 1), (2, 2), (3, 3)] and table.run == "a"
    assert table.commit(patch, days, run="b") and not table.commit(patch, days, run="b")
    assert held() == [(1, 1), (3, 2), (3, 30)] and table.days() == [day(1), day(3)]
    assert [r["n"] for r in rows(table.read([day(1), day(2)]))] == [1]
    with pytest.raises(ValueError):
        table.commit(frame((7, 1)), [day(8)])
    assert table.vacuum() == 3 and held() == [(1, 1), (3, 2), (3, 30)]
    table.commit(frame(), [day(1), day(3)])
    assert held() == [] and table.read().columns == ["event_date", "n"]


def test_ten_batches_of_one_day_read_their_own_rows(spark, landing, tmp_path):
    raw = materialize(events.read_events(spark, landing).filter("event_date < '2024-01-04'").withColumn("event_date", F.lit(dt.date(2024, 1, 1))), "one-day")
    place, mart = str(tmp_path / "raw"), str(tmp_path / "mart")
    for i in range(10):
        raw.filter(F.col("event_timestamp") % 10 == i).coalesce(1).write.mode("append").partitionBy("event_date").parquet(place)
    query = daily_funnel.stream_daily_funnel(daily_funnel.stream_raw_events(spark, place, files_per_batch=1), mart, str(tmp_path / "state"))
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 10 and sum(p["numInputRows"] for p in batches) == raw.count()
    assert all(s["numRowsUpdated"] <= p["numInputRows"] for p in batches for s in p["stateOperators"])
    table = DayTable(spark, mart)
    assert same(table.read(), daily_funnel.daily_from_raw(raw)) and table.run == "9"


def test_a_batch_that_runs_twice_adds_once(spark, tmp_path):
    change = lambda *rows: spark.createDataFrame(
        [(s, dt.date(2024, 1, d), "Direct", "mobile", None, True, *[True] * 6, Decimal(r)) for s, d, r in rows],
        "sign int, event_date date, channel_group string, device_category string, country string, is_new_user boolean, "
        + ", ".join(f"{c} boolean" for c in REACHED) + ", session_revenue decimal(18,2)")
    mart = str(tmp_path / "mart")
    add = daily_funnel._add_changes(mart)
    for batch, batch_id in ((change((1, 5, "1.10"), (1, 5, "2.20")), 0), (change((-1, 5, "1.10"), (1, 4, "1.10")), 1), (change(), 2), (change((-1, 5, "2.20"), (1, 5, "0.00")), 3)):
        add(batch, batch_id)
        add(batch, batch_id)
    got = rows(DayTable(spark, mart).read().select("event_date", "sessions", "transactions", "revenue"), "event_date")
    assert [tuple(r.values()) for r in got] == [(dt.date(2024, 1, 4), 1, 1, 1.1), (dt.date(2024, 1, 5), 1, 0, 0.0)]


partial = st.tuples(
    st.sampled_from([None, "T1", "T2"]), st.dates(dt.date(2024, 1, 1), dt.date(2024, 1, 5)), *[st.sampled_from([None, "a", "b", "é"])] * 7, st.integers(0, 6), st.booleans(), st.sampled_from([None, 0, 5, 700]))


@given(st.lists(partial, min_size=1, max_size=6), st.integers(0, 6), st.randoms())
def test_partial_rows_merge_in_any_order_and_grouping(items, cut, random):
    whole = session_state.merged(None, iter(items))
    mixed = random.sample(items, len(items))
    first = session_state.merged(None, iter(mixed[:cut])) if mixed[:cut] else None
    assert session_state.merged(first, iter(mixed[cut:] + mixed[:1])) == whole


def test_session_across_midnight_keeps_its_first_day(spark, landing):
    raw = events.read_events(spark, landing, start=dt.date(2024, 1, 9), end=dt.date(2024, 1, 9)).limit(5)
    next_day = raw.withColumn("event_date", F.date_add("event_date", 1)).withColumn("event_timestamp", F.col("event_timestamp") + 86_400_000_000)
    both = materialize(raw.unionByName(next_day), "midnight")
    rebuilt = daily_funnel.rebuild_days(both, [dt.date(2024, 1, 10)])
    assert rebuilt.count() == 0 and stg_events(both).count() == 10


def test_stream_equals_batch(spark, landing, tmp_path):
    stream = daily_funnel.stream_raw_events(spark, landing, files_per_batch=12)
    mart = str(tmp_path / "mart")
    daily_funnel.stream_daily_funnel(stream, mart, str(tmp_path / "state")).awaitTermination()
    assert same(DayTable(spark, mart).read(), daily_funnel.daily_from_raw(events.read_events(spark, landing)))


def test_a_batch_costs_as_many_state_calls_as_pages(spark, landing, tmp_path, monkeypatch):
    monkeypatch.setattr(session_state, "PAGES", 8, raising=False)
    raw = materialize(events.read_events(spark, landing).filter("event_date < '2024-01-07'"), "few-pages")
    place, mart = str(tmp_path / "raw"), str(tmp_path / "mart")
    for i in range(3):  # every batch comes back to sessions of all pages
        raw.filter(F.col("event_timestamp") % 3 == i).coalesce(1).write.mode("append").parquet(place)
    query = daily_funnel.stream_daily_funnel(daily_funnel.stream_raw_events(spark, place, files_per_batch=1), mart, str(tmp_path / "state"))
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 3 and stg_events(raw).select("user_pseudo_id", "ga_session_id").distinct().count() > 3 * 8
    assert all(0 < s["numRowsUpdated"] <= 8 for p in batches for s in p["stateOperators"])
    assert same(DayTable(spark, mart).read(), daily_funnel.daily_from_raw(raw))
