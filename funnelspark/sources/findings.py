"""Append-only log of reported findings.

A run writes its findings to folders by day and run, so a run that is replayed
replaces what it wrote, and nothing is in the log twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.schema import FINDING


def append_findings(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.select(*FINDING.fieldNames()).write.mode("append").format(fmt).save(path)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """The findings of one run, each (key, pair) once; writing the run again changes nothing.

    A run that found nothing more on a day it had written keeps that day's rows.
    """
    rows = df.select(*FINDING.fieldNames()).dropDuplicates(["as_of", "key", "w0", "w1"]).withColumn("run_id", F.lit(run_id))
    (
        rows.repartition("as_of").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of", "run_id").parquet(path)
    )


def read_runs(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Findings written by ``append_run`` with their run; only folders of the days asked for are read."""
    log = read_findings(spark, path)
    if "run_id" not in log.columns:
        log = log.withColumn("run_id", F.lit(None).cast("string"))
    for bound, keep in ((start, F.col("as_of") >= F.lit(start)), (end, F.col("as_of") <= F.lit(end))):
        log = log if bound is None else log.filter(keep)
    return log.select(*FINDING.fieldNames(), F.col("run_id").cast("string").alias("run_id"))


def latest_findings(log: DataFrame) -> DataFrame:
    """The newest finding of each key; of several on one day, that of the latest pair, then of the last run by name."""
    newest = F.max_by(F.struct(*FINDING.fieldNames(), "run_id"), F.struct("as_of", "w1", "w0", "run_id"))
    return log.groupBy("key").agg(newest.alias("newest")).select("newest.*")


def read_findings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All findings; an empty table before the first one was saved."""
    try:
        return spark.read.schema(FINDING).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], FINDING)
        raise
