"""Staged events stored in buckets of users, sorted by session.

A task of a reader gets one bucket, a sorted file with all events of its users.
Aggregates by session, by transaction and by user find their rows together and
in order, so they need neither an exchange nor a sort of events.

A bucket is one task, so a user with more events than a bucket should hold must
not be in one. Such users are counted when the table is written and go to a
table of their own without buckets, where events are reduced in every task and
then exchanged. There are fewer of them than buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USER = "user_pseudo_id"
ORDER = (USER, "ga_session_id", "transaction_id")


class EventStore:
    """The tables ``name`` (bucketed) and ``name_heavy`` of the session catalog, with files under ``path``."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path.rstrip("/")
        # the scan tells the planner its order only with this setting; files are sorted when written, one for each bucket
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def write(self, stg: DataFrame, buckets: int) -> "EventStore":
        """Store staged events; a user with more than a bucket's share of the events is heavy."""
        counts = stg.groupBy(USER).agg(F.count(F.lit(1)).alias("n"))
        share = counts.agg(F.sum("n")).scalar() / buckets
        heavy = [r[0] for r in counts.filter(F.col("n") > share).select(USER).collect()]  # fewer than buckets
        # a missing user is nobody's key: its events share no session
        is_heavy = F.coalesce(F.col(USER).isin(heavy), F.lit(None in heavy))
        rows = stg.filter(~is_heavy).repartition(buckets, USER)
        rows.write.mode("overwrite").option("path", f"{self.path}/buckets").bucketBy(buckets, USER).sortBy(*ORDER).saveAsTable(self.name)
        stg.filter(is_heavy).write.mode("overwrite").option("path", f"{self.path}/heavy").saveAsTable(f"{self.name}_heavy")
        return self

    def open(self, buckets: int) -> "EventStore":
        """Name files written by another session in this session's catalog."""
        columns = self.spark.read.parquet(f"{self.path}/buckets").schema.toDDL()
        for table, folder, clause in (
            (self.name, "buckets", f"CLUSTERED BY ({USER}) SORTED BY ({', '.join(ORDER)}) INTO {buckets} BUCKETS"), (f"{self.name}_heavy", "heavy", "")):
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {clause} LOCATION '{self.path}/{folder}'")
        return self

    def by_user(self, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``build`` of the events, where it keeps users apart: buckets and heavy users are built on their own."""
        heavy = self.spark.table(f"{self.name}_heavy")
        rows = build(self.spark.table(self.name))
        return rows if heavy.isEmpty() else rows.unionByName(build(heavy))
