"""A table partitioned by day, or by the first day of a longer stretch, in which one commit replaces some days and empties others.

A commit writes the new rows of its days to a folder of its own, then a manifest
that names the folder of every day. Readers take the newest manifest, so they
see all of a commit or nothing. A run that fails before its manifest leaves an
unnamed folder behind, which ``vacuum`` removes; running it again gives the same
table. A commit carries the label of its run, and a label that was committed
already is passed over.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "event_date"
MANIFEST = "version long, event_date date, folder string, run string, source string, schema string"


class DayTable:
    def __init__(self, spark: SparkSession, path: str, day: str = DAY):
        self.spark, self.path, self.day = spark, path.rstrip("/"), day

    def _manifest(self) -> list:
        """Rows of the newest manifest: one for each day, and one without a day for the commit itself."""
        try:
            held = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/_manifests/*")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        newest = held.agg(F.max("version")).scalar()
        return held.filter(F.col("version") == newest).collect()  # calendar days, not rows

    def _head(self, held: list):
        return next((r for r in held if r.event_date is None), None)

    @property
    def run(self) -> str | None:
        """Label of the last commit."""
        head = self._head(self._manifest())
        return head and head.run

    @property
    def source(self) -> str | None:
        """What the last commit recorded about its input."""
        head = self._head(self._manifest())
        return head and head.source

    def days(self) -> list[dt.date]:
        return sorted(r.event_date for r in self._manifest() if r.event_date is not None)

    def read(self, days: Iterable[dt.date] | None = None) -> DataFrame:
        """Rows of the newest commit; with ``days``, of those days alone."""
        held = self._manifest()
        if not held:
            raise ValueError(f"nothing was committed to {self.path}")
        schema = T._parse_datatype_json_string(self._head(held).schema)
        wanted = None if days is None else set(days)
        folders = [f"{r.folder}/{self.day}={r.event_date}" for r in held if r.event_date is not None and (wanted is None or r.event_date in wanted)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        # the day comes from the folder's name; all commits lie side by side under one base
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{f}" for f in folders))
        return rows.select(*schema.fieldNames())

    def commit(self, df: DataFrame, days: Iterable[dt.date] | None = None, run: str | None = None, source: str | None = None) -> bool:
        """Replace ``days`` by the rows of ``df``; those without rows are empty afterwards. False if ``run`` was committed last.

        Without ``days`` the whole table is replaced. Rows of other days are an error.
        """
        held = self._manifest()
        head = self._head(held)
        if run is not None and head is not None and head.run == run:
            return False
        folder = f"commit={uuid.uuid4().hex}"
        target = f"{self.path}/data/{folder}"
        order = [c for c in (self.day, "device_category", "channel_group") if c in df.columns]
        df.hint("rebalance", self.day).sortWithinPartitions(*order).write.partitionBy(self.day).parquet(target)
        written = {r[0] for r in self.spark.read.schema(df.schema).option("basePath", target).parquet(target).select(self.day).distinct().collect()}
        if None in written or (days is not None and not written <= set(days)):
            raise ValueError(f"rows outside the days of the commit: {sorted(map(str, written - set(days or ())))[:3]}")
        kept = [] if days is None else [(r.event_date, r.folder) for r in held if r.event_date is not None and r.event_date not in set(days)]
        version = head.version + 1 if head else 0
        named = [(version, day, where, None, None, None) for day, where in [*kept, *((d, folder) for d in written)]]
        rows = self.spark.createDataFrame([*named, (version, None, None, run, source, df.schema.json())], MANIFEST)
        # fails if another writer was first
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/_manifests/{version:012d}")
        return True

    def record(self, df: DataFrame) -> str:
        """Keep a table next to the data, to be named as the source of a commit; returns its path."""
        path = f"{self.path}/_sources/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def vacuum(self) -> int:
        """Delete the folders that the newest manifest doesn't name, and older manifests; returns how many went.

        Readers that opened an older commit lose its files, so call it when none is at work.
        """
        held = self._manifest()
        used = {r.folder for r in held if r.folder is not None}
        head = self._head(held)
        newest, source = f"{head.version:012d}", (head.source or "").rpartition("/")[2]
        jvm = self.spark.sparkContext._jvm
        gone = 0
        for folder, keep in ((f"{self.path}/data", used), (f"{self.path}/_manifests", {newest}), (f"{self.path}/_sources", {source})):
            top = jvm.org.apache.hadoop.fs.Path(folder)
            fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for status in fs.listStatus(top) if fs.exists(top) else ():
                if status.getPath().getName() not in keep:
                    gone += fs.delete(status.getPath(), True)
        return gone
