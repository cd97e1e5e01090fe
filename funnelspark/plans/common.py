"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.functions.numeric import rounded
from funnelspark.plans.marts import Marts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Marts], DataFrame]) -> Callable[[Marts], DataFrame]:
    """Registers a function of the marts under its own name."""
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(Marts(spark, sf_dir))
    return build


def report(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """The named columns; doubles rounded, timestamps as epoch microseconds."""
    kinds = dict(df.dtypes)

    def shape(name: str):
        kind = kinds[name]
        if kind == "double":
            return rounded(name, digits).alias(name)
        if kind == "timestamp":
            return F.unix_micros(name).alias(name)
        if kind in ("int", "smallint", "tinyint"):
            return F.col(name).cast("long").alias(name)
        return F.col(name)

    return df.select(*[shape(c) for c in (columns or df.columns)])
