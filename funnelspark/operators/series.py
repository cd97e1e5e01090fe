"""Forecast and anomaly detection over metric series.

A series holds one point per period after aggregation, so its length is the
number of days or weeks on record. Windows are per series and never run over
events.
"""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions.numeric import safe_divide

SIGMA_FLOOR_SHARE = 0.01
SIGMA_FLOOR = 1e-12
# Defaults of the alternative detectors.
SCORE_THRESHOLD = 3.0
EWMA_ALPHA = 0.3
# Points folded into one array before they are added to the rest.
EWMA_BLOCK = 256
IQR_FENCE = 1.5


def rolling_residuals(points: DataFrame, series: str, t: str, value: str, k: int) -> DataFrame:
    """Adds the mean of the previous k points, the residual and the series' sigma.

    Sigma covers the whole series, the scored point included, and has a floor of
    one percent of the mean level.
    """
    ordered = Window.partitionBy(series).orderBy(t)
    whole = Window.partitionBy(series)
    with_index = (
        points.withColumn("position", F.row_number().over(ordered) - 1)
        .withColumn("rolling_mean", F.avg(value).over(ordered.rowsBetween(-k, -1)))
        .withColumn("residual", F.col(value) - F.col("rolling_mean"))
    )
    spread = F.coalesce(F.stddev_pop("residual").over(whole), F.lit(0.0))
    floor = F.lit(SIGMA_FLOOR_SHARE) * F.abs(F.avg(value).over(whole))
    return with_index.withColumn("sigma", F.greatest(spread, floor, F.lit(SIGMA_FLOOR)))


def detect_anomaly(
    points: DataFrame, series: str = "series_id", t: str = "t", value: str = "value",
    k: int = 4, z_threshold: float = 2.5, min_history: int = 3,
) -> DataFrame:
    """Each point against the rolling forecast; early points stay unscored."""
    scored = F.col("position") >= min_history
    z = F.when(scored, F.col("residual") / F.col("sigma")).otherwise(0.0)
    result = rolling_residuals(points, series, t, value, k).withColumn("z", z)
    return result.select(
        series, t, value, "position",
        F.when(scored, F.col("rolling_mean")).alias("forecast"),
        "sigma", "z", (F.abs("z") > z_threshold).alias("is_anomaly"),
    )


def forecast_next(
    points: DataFrame, series: str = "series_id", t: str = "t", value: str = "value", k: int = 4, conf: float = 0.95,
) -> DataFrame:
    """Next value per series: mean of the last k points with a prediction interval."""
    latest_first = Window.partitionBy(series).orderBy(F.col(t).desc())
    recent = rolling_residuals(points, series, t, value, k).withColumn("recency", F.row_number().over(latest_first))
    z = statistics.NormalDist().inv_cdf(1 - (1 - conf) / 2)
    out = recent.groupBy(series).agg(
        F.avg(F.when(F.col("recency") <= k, F.col(value))).alias("forecast"), F.max("sigma").alias("sigma")
    )
    return out.select(
        series, "forecast",
        (F.col("forecast") - z * F.col("sigma")).alias("low"),
        (F.col("forecast") + z * F.col("sigma")).alias("high"),
        "sigma",
    )


def iqr_anomaly(
    points: DataFrame, series: str = "series_id", t: str = "t", value: str = "value", fence: float = IQR_FENCE
) -> DataFrame:
    """Points beyond the quartile fences of their series."""
    quartiles = points.groupBy(series).agg(
        F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3")
    )
    joined = points.join(quartiles, series)
    spread = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - fence * spread, F.col("q3") + fence * spread
    over = F.greatest(low - F.col(value), F.col(value) - high, F.lit(0.0))
    return joined.select(
        series, t, value, "q1", "q3",
        F.coalesce(safe_divide(over, spread), F.lit(0.0)).alias("score"),
        ((F.col(value) < low) | (F.col(value) > high)).alias("is_anomaly"),
        _direction(F.col(value), low, high).alias("direction"),
    )


def _direction(value: Column, low: Column, high: Column) -> Column:
    return F.when(value > high, "up").when(value < low, "down").otherwise("none")


def ewma_anomaly(
    points: DataFrame, series: str = "series_id", t: str = "t", value: str = "value",
    alpha: float = EWMA_ALPHA, threshold: float = SCORE_THRESHOLD,
) -> DataFrame:
    """Residuals against an exponentially weighted level of the earlier points.

    The level depends on its own previous value, so the points of a series (one
    per period) are folded in order, in blocks that carry the level on; the cost
    is linear in the length of the series.
    """
    entry = F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("value"))
    ordered = points.groupBy(series).agg(F.array_sort(F.collect_list(entry)).alias("points"))
    out_type = f"array<struct<t:{points.schema[t].dataType.simpleString()},value:double,level:double>>"
    start = F.struct(F.lit(None).cast("double").alias("level"), F.array().cast(out_type).alias("out"))

    def step(state: Column, point: Column) -> Column:
        level = state["level"]
        scored = F.struct(point["t"].alias("t"), point["value"].alias("value"), level.alias("level"))
        following = F.when(level.isNull(), point["value"]).otherwise(alpha * point["value"] + (1 - alpha) * level)
        return F.struct(following.alias("level"), F.concat(state["out"], F.array(scored)).alias("out"))

    # a block's points are added to a short array, the blocks to an array of blocks
    starts = F.sequence(F.lit(0), F.size("points") - 1, F.lit(EWMA_BLOCK))
    blocks = F.transform(starts, lambda s: F.slice("points", s + 1, EWMA_BLOCK))
    empty = F.struct(F.lit(None).cast("double").alias("level"), F.array().cast(f"array<{out_type}>").alias("out"))

    def fold(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["level"].alias("level"), start["out"].alias("out")), step)
        return F.transform(F.array(inner), lambda r: F.struct(r["level"].alias("level"), F.concat(state["out"], F.array(r["out"])).alias("out")))[0]

    folded = ordered.select(series, F.explode(F.flatten(F.aggregate(blocks, empty, fold, lambda s: s["out"]))).alias("p"))
    flat = folded.select(series, F.col("p.t").alias(t), F.col("p.value").alias(value), F.col("p.level").alias("level"))
    residual = F.col(value) - F.col("level")
    sigma = F.stddev_pop(residual).over(Window.partitionBy(series))
    scored = flat.withColumn("score", F.coalesce(safe_divide(residual, sigma), F.lit(0.0)))
    return scored.withColumn("is_anomaly", F.abs("score") > threshold)


def seasonal_residual(
    points: DataFrame, series: str = "series_id", t: str = "t", value: str = "value",
    span: int = 7, threshold: float = SCORE_THRESHOLD,
) -> DataFrame:
    """Daily points without their trailing level and their weekday pattern.

    level = mean of the last ``span`` points; seasonal = mean of value - level
    per weekday; residual = what is left, scored by its standard deviation.
    """
    trailing = Window.partitionBy(series).orderBy(t).rowsBetween(-(span - 1), 0)
    weekday = Window.partitionBy(series, F.dayofweek(t))
    whole = Window.partitionBy(series)
    split = (
        points.withColumn("level", F.avg(value).over(trailing))
        .withColumn("seasonal", F.avg(F.col(value) - F.col("level")).over(weekday))
        .withColumn("residual", F.col(value) - F.col("level") - F.col("seasonal"))
    )
    scored = split.withColumn(
        "score", F.coalesce(safe_divide("residual", F.stddev_pop("residual").over(whole)), F.lit(0.0))
    )
    return scored.withColumn("is_anomaly", F.abs("score") > threshold)
