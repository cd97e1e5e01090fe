"""Bitmaps of the days a user was active, mergeable day by day.

A row holds a user's active days of 64 days in the bits of one number, and the
first session in them. Rows of one user and stretch merge by OR and by the
smaller first session, in any order and any number of times, so today's sessions
join yesterday's bitmaps without a look at old sessions; only the stretch that
holds today is read and replaced. (Spark's own bitmap aggregates take 4 KB for
each group, a user with a row in every stretch of a year takes 48 bytes.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.operators.cohorts import COHORT_DIMS
from funnelspark.sources.daytable import DayTable

DAYS = 64
STRETCH = "stretch_start"


def active_days(sessions: DataFrame) -> DataFrame:
    """user_pseudo_id, stretch_start, bits and first (time, key and dimensions of the first session) of a session table."""
    day = F.unix_date("event_date")
    rows = sessions.withColumns({
        STRETCH: F.date_from_unix_date(day - F.pmod(day, F.lit(DAYS))), "bit": F.expr(f"shiftleft(1L, pmod(unix_date(event_date), {DAYS}))"),
        "first": F.struct("session_start_ts", "session_key", *COHORT_DIMS),
    })
    return _grouped(rows, "bit")


def _grouped(rows: DataFrame, bits: str) -> DataFrame:
    return rows.groupBy("user_pseudo_id", STRETCH).agg(F.bit_or(bits).alias("bits"), F.min("first").alias("first"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return _grouped(a.unionByName(b), "bits")


def add_sessions(table: DayTable, sessions: DataFrame) -> None:
    """Merge new sessions into the bitmaps of ``table``, a ``DayTable`` by stretch.

    Adding the same sessions again changes nothing. A bit is never taken back:
    where sessions left a day, commit ``active_days`` of all sessions of its
    stretch instead.
    """
    new = active_days(sessions)
    if not table.days():
        table.commit(new)
        return
    # some stretches of 64 days, not rows
    touched = [r[0] for r in new.select(STRETCH).distinct().collect()]
    table.commit(merge(table.read(touched), new), touched)


def users(bitmaps: DataFrame) -> DataFrame:
    """One row per user as ``cohorts.user_days`` gives it: first day, sorted days, key and dimensions of the first session."""
    held = F.array_sort(F.collect_list(F.struct(STRETCH, "bits")))
    rows = bitmaps.groupBy("user_pseudo_id").agg(F.min("first").alias("first"), held.alias("held"))
    days = F.expr(f"flatten(transform(held, h -> transform(filter(sequence(0, {DAYS - 1}), i -> bit_get(h.bits, i) = 1), i -> date_add(h.{STRETCH}, i))))")
    return rows.withColumn("days", days).select(
        "user_pseudo_id", F.col("first.session_key").alias("session_key"), F.get("days", F.lit(0)).alias("first_date"), "days", *(F.col(f"first.{d}").alias(d) for d in COHORT_DIMS))
