"""Table sinks: full refresh and replacement of whole day partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_mart(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Full refresh. A partitioned table is clustered first: few files per partition."""
    if partition_by is not None:
        write_partitions(df, path, partition_by, "static")
    else:
        df.write.mode("overwrite").parquet(path)


def upsert_partitions(df: DataFrame, path: str, partition_by: str = "event_date") -> None:
    """Replace the partitions present in ``df`` and leave all others; idempotent."""
    write_partitions(df, path, partition_by, "dynamic")


def write_partitions(df: DataFrame, path: str, partition_by: str, mode: str) -> None:
    # The rebalance hint lets adaptive execution split a day that holds much of
    # the data and merge days that hold little.
    clustered = df.hint("rebalance", partition_by)
    order = [c for c in (partition_by, "device_category", "channel_group") if c in df.columns]
    (
        clustered.sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy(partition_by)
        .parquet(path)
    )


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
