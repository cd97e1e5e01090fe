"""Bucketed events and bitmaps of active days."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from funnelspark.operators import active_days, cohorts, sessions
from funnelspark.session import materialize
from funnelspark.sources.daytable import DayTable
from funnelspark.sources.eventstore import EventStore
from tests.conftest import rows


def funnel(stg):
    return sessions.funnel_facts(sessions.session_rollup(stg))


def users(stg):
    return cohorts.user_days(sessions.fct_sessions(sessions.session_rollup(stg)))


def nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"^[ :+\-*()\d]*([A-Z]\w+)", plan, re.M)


def same(got, expected):
    got = got.select(*expected.columns)
    return got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


@pytest.fixture(scope="module")
def staged(marts):
    return materialize(marts.stg, "staged")


@pytest.fixture(scope="module")
def store(spark, staged, tmp_path_factory):
    return EventStore(spark, "plain_events", str(tmp_path_factory.mktemp("store"))).write(staged, 4)


def test_bucketed_sessions_need_no_exchange_and_no_sort_of_events(store, staged):
    plan = nodes(store.by_user(funnel))
    assert "Exchange" not in plan and "Sort" not in plan and "SortAggregate" in plan
    assert "Exchange" in nodes(funnel(staged))
    # from events to users without an exchange; days of a user are gathered after their sessions
    assert "Exchange" not in nodes(store.by_user(users))
    assert same(store.by_user(funnel), funnel(staged)) and same(store.by_user(users), users(staged))


def test_heavy_users_are_built_apart(spark, staged, tmp_path):
    heavy = staged.unionByName(staged.filter("user_pseudo_id = 'u3'").crossJoin(spark.range(400).select()))
    nobody = staged.limit(5).withColumn("user_pseudo_id", F.lit(None).cast("string"))
    events = materialize(heavy.unionByName(nobody), "heavy-events")
    store = EventStore(spark, "heavy_events", str(tmp_path)).write(events, 8)
    assert [r[0] for r in spark.table("heavy_events_heavy").select("user_pseudo_id").distinct().collect()] == ["u3"]
    assert same(store.by_user(funnel), funnel(events))


def test_a_store_is_opened_by_another_session(spark, store, staged):
    again = EventStore(spark, "reopened", store.path).open(4)
    assert "Exchange" not in nodes(again.by_user(funnel)) and same(again.by_user(funnel), funnel(staged))


def test_bitmaps_merge_in_any_order_and_twice(spark, marts, tmp_path):
    shifted = marts.sessions.withColumn("event_date", F.date_add("event_date", (F.crc32(F.col("session_key").cast("binary")) % 3 * 70).cast("int")))
    early = marts.sessions.withColumn("event_date", F.date_sub("event_date", 20_000))
    every = materialize(shifted.unionByName(early), "spread-sessions")
    expected = cohorts.user_days(every)
    table = DayTable(spark, str(tmp_path / "t"), active_days.STRETCH)
    parts = [every.filter(F.crc32(F.col("session_key").cast("binary")) % 4 == i) for i in (2, 0, 3, 1)]
    for part in (*parts, parts[1]):
        active_days.add_sessions(table, part)
    assert same(active_days.users(table.read()), expected)
    assert len(table.days()) > 3 and min(table.days()) < dt.date(1970, 1, 1)


def test_a_day_is_added_without_old_stretches(spark, marts, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), active_days.STRETCH)
    active_days.add_sessions(table, marts.sessions)
    before = {r.event_date: r.folder for r in table._manifest() if r.event_date}
    active_days.add_sessions(table, marts.sessions.withColumn("event_date", F.lit(dt.date(2024, 6, 1))))
    after = {r.event_date: r.folder for r in table._manifest() if r.event_date}
    assert len(after) == len(before) + 1 and before.items() <= after.items()
    last = rows(active_days.users(table.read()).select(F.element_at("days", -1).alias("d")).distinct())
    assert last == [{"d": dt.date(2024, 6, 1)}]
