"""Daily funnel kept up to date, by rebuilt days or by a stream of changes.

A session belongs to the day of its first event. The mart is a ``DayTable``: a
commit replaces the days it was given, and empties those that have no session
any more.

``refresh_changed`` compares the landed files with those that the last commit
saw. The days of files that came or went, and their neighbours, are rebuilt,
however old they are; a rebuild reads one day more on either side, so that a
session crossing midnight is seen whole.

``stream_daily_funnel`` rereads nothing: sessions live in the state store (see
``session_state``), and each micro-batch adds signed changes to the cells of the
days it touched. State is kept for good, so an event of any age finds its
session; RocksDB holds it on the executors' disks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from funnelspark.functions.events import surrogate_key
from funnelspark.functions.numeric import money_sum
from funnelspark.operators.daily import ADDITIVE, COUNTS, DAILY_KEYS, STEP_COUNTS, fct_daily_funnel
from funnelspark.operators.sessions import funnel_facts, has_revenue, session_rollup
from funnelspark.operators.staging import stg_events
from funnelspark.schema import RAW_EVENT
from funnelspark.session import materialize
from funnelspark.sources.daytable import DayTable
from funnelspark.sources.events import read_events
from funnelspark.streaming.session_state import session_changes

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FILE = ("file_path", "file_size", "file_modification_time")


def daily_from_raw(raw: DataFrame) -> DataFrame:
    return fct_daily_funnel(funnel_facts(session_rollup(stg_events(raw))))


def _around(days: Iterable[dt.date]) -> list[dt.date]:
    return sorted({d + dt.timedelta(days=shift) for d in days for shift in (-1, 0, 1)})


def rebuild_days(raw: DataFrame, days: Iterable[dt.date]) -> DataFrame:
    """Daily funnel of exactly these days, from their events and those of the days next to them."""
    days = list(days)
    return daily_from_raw(raw.filter(F.col("event_date").isin(_around(days)))).filter(F.col("event_date").isin(days))


# ── rebuilt days ─────────────────────────────────────────────────────────────


def landed_files(spark: SparkSession, landing: str) -> DataFrame:
    """One row per landed file: its day, path, size and time. File contents aren't read."""
    files = spark.read.format("binaryFile").load(landing)
    return files.select(F.col("event_date").cast("date").alias("event_date"), *(F.col(f"_metadata.{c}").alias(c) for c in _FILE))


def _new_files(files: DataFrame, table: DayTable) -> DataFrame:
    """Files that came, went or changed since the last commit."""
    if table.source is None:
        return files
    seen = files.sparkSession.read.schema(files.schema).parquet(table.source)
    return files.join(seen, list(_FILE), "left_anti").unionByName(seen.join(files, list(_FILE), "left_anti"))


def refresh_changed(spark: SparkSession, landing: str, mart_path: str) -> list[dt.date]:
    """Rebuild the days whose files changed since the last refresh, and their neighbours; returns all of them.

    The first refresh builds everything. The inventory of files is written before
    the events are read: a file that lands meanwhile counts as new next time.
    """
    table = DayTable(spark, mart_path)
    inventory = table.record(landed_files(spark, landing))
    files = spark.read.parquet(inventory)
    changed = [r[0] for r in _new_files(files, table).select("event_date").distinct().collect()]  # calendar days, not rows
    if not changed:
        return []
    raw = read_events(spark, landing)
    if table.source is None:
        table.commit(daily_from_raw(raw), source=inventory)
        return table.days()
    days = _around(changed)
    table.commit(rebuild_days(raw, days), days, source=inventory)
    return days


def late_events(spark: SparkSession, landing: str, mart_path: str) -> DataFrame:
    """Landed events that the mart hasn't seen yet, counted by day."""
    new = _new_files(landed_files(spark, landing), DayTable(spark, mart_path)).select("file_path").distinct()
    events = read_events(spark, landing).select("event_date", "_metadata.file_path")
    return events.join(new, "file_path", "left_semi").groupBy("event_date").agg(F.count(F.lit(1)).alias("late_events"))


# ── stream of changes ────────────────────────────────────────────────────────


def stream_raw_events(spark: SparkSession, landing_path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of landed event files."""
    return spark.readStream.schema(RAW_EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(landing_path)


def _signed_cells(changes: DataFrame) -> DataFrame:
    """Signed session rows added up by cell."""
    number = lambda condition: F.sum(F.when(condition, F.col("sign")).otherwise(0)).cast("long")
    return changes.groupBy(*DAILY_KEYS).agg(
        number(F.lit(True)).alias("sessions"), *(number(F.col(flag)).alias(name) for name, flag in STEP_COUNTS.items()),
        number(has_revenue()).alias("transactions"), money_sum(F.col("session_revenue") * F.col("sign")).alias("revenue"),
    )


def add_cells(daily: DataFrame, cells: DataFrame) -> DataFrame:
    """The daily funnel with signed cells added; cells without sessions go."""
    both = daily.select(*DAILY_KEYS, *ADDITIVE).unionByName(cells)
    sums = both.groupBy(*DAILY_KEYS).agg(*(F.sum(c).alias(c) for c in (*COUNTS, "transactions")), money_sum("revenue").alias("revenue"))
    return sums.filter("sessions > 0").select(surrogate_key(*DAILY_KEYS).alias("daily_funnel_key"), *DAILY_KEYS, *ADDITIVE)


def _add_changes(mart_path: str) -> Callable[[DataFrame, int], None]:
    def add(batch: DataFrame, batch_id: int) -> None:
        table = DayTable(batch.sparkSession, mart_path)
        done = table.run
        if done is not None and int(done) >= batch_id:
            return  # a batch that ran before its commit was noted
        cells = materialize(_signed_cells(batch), "changed-cells")
        days = [r[0] for r in cells.select("event_date").distinct().collect()]  # calendar days, not rows
        if done is None:
            table.commit(add_cells(cells.limit(0), cells), run=str(batch_id))
        elif days:
            table.commit(add_cells(table.read(days), cells), days, run=str(batch_id))

    return add


def stream_daily_funnel(stream: DataFrame, mart_path: str, checkpoint_path: str, available_now: bool = True) -> StreamingQuery:
    """Keep the daily funnel current: each micro-batch adds its changes to the days it touched.

    A batch is committed under its number, so one that runs again after a failure adds nothing twice.
    """
    conf = stream.sparkSession.conf
    if conf.get(PROVIDER).endswith(".HDFSBackedStateStoreProvider"):  # the default, which holds all states in memory
        conf.set(PROVIDER, ROCKSDB)
    writer = session_changes(stg_events(stream)).writeStream.outputMode("update").foreachBatch(_add_changes(mart_path))
    writer = writer.option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
