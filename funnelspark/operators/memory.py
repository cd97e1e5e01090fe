"""Finding log, seasonal calendar and the decision to report or stay silent."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelspark.functions.numeric import safe_divide
from funnelspark.operators.verdict import MATERIALITY, top_driver

REPEAT_WINDOW_DAYS = 14
PRIOR_DECAY_DAYS = 60.0
WEEK_DAYS = 7
CANDIDATE_BLOCK = 512
MEMORY_BLOCK = 8192

# Default seasonal calendar, in order of precedence.
SEASONS = (
    ("Black Friday", dt.date(2020, 11, 26), dt.date(2020, 11, 29)),
    ("Cyber Monday", dt.date(2020, 11, 30), dt.date(2020, 12, 1)),
    ("Christmas peak", dt.date(2020, 12, 20), dt.date(2020, 12, 26)),
    ("New Year", dt.date(2020, 12, 31), dt.date(2021, 1, 2)),
    ("Post-holiday January trough", dt.date(2021, 1, 2), dt.date(2021, 1, 15)),
)


# ── seasonal calendar ─────────────────────────────────────────────────────────

def seasonal_calendar(spark: SparkSession, events: Sequence[tuple[str, dt.date, dt.date]] = SEASONS) -> DataFrame:
    rows = [(order, *event) for order, event in enumerate(events)]
    return spark.createDataFrame(rows, "ordinal int, event string, start_date date, end_date date")


def _by_day(calendar: DataFrame, days_before: int) -> DataFrame:
    """The first listed event per day, each event also covering ``days_before`` earlier days.

    Spelling the intervals out as days turns the range condition into an
    equi-join with at most one match per day.
    """
    days = F.sequence(F.date_sub("start_date", days_before), F.col("end_date"))
    spread = calendar.select("ordinal", "event", F.explode(days).alias("calendar_day"))
    return spread.groupBy("calendar_day").agg(F.min_by("event", "ordinal").alias("season"))


def event_on(df: DataFrame, day: str, calendar: DataFrame) -> DataFrame:
    """Adds ``season``: the event that covers ``day``, else NULL."""
    days = _by_day(calendar, 0)
    return df.join(days, df[day] == days["calendar_day"], "left").drop("calendar_day")


def event_for_week(df: DataFrame, week: str, calendar: DataFrame) -> DataFrame:
    """Adds ``season``: the first event that overlaps the seven days from ``week`` on."""
    days = _by_day(calendar, WEEK_DAYS - 1)
    return df.join(days, df[week] == days["calendar_day"], "left").drop("calendar_day")


# ── findings ──────────────────────────────────────────────────────────────────

def direction(delta: str = "delta") -> Column:
    return F.when(F.col(delta) < 0, "down").otherwise("up")


def finding_key(dominant: Column | str, segment: Column | str, delta: str = "delta") -> Column:
    return F.concat_ws("|", dominant, segment, direction(delta))


def to_findings(judged: DataFrame, as_of: Column | str) -> DataFrame:
    """Diagnoses with a verdict as rows of the finding log."""
    segment = top_driver()
    as_of = F.col(as_of) if isinstance(as_of, str) else as_of
    return judged.select(
        as_of.cast("date").alias("as_of"), "w0", "w1", finding_key("dominant", segment).alias("key"),
        "dominant", segment.alias("segment"), direction().alias("direction"), "delta", "revenue_at_risk", "verdict",
    )


def recall_order(findings: DataFrame) -> DataFrame:
    """Adds ``recall_rank``: 1 for the newest finding of each key."""
    newest = Window.partitionBy("key").orderBy(F.col("as_of").desc(), F.col("w1").desc(), F.col("w0").desc())
    return findings.withColumn("recall_rank", F.row_number().over(newest))


def recall_prior(findings: DataFrame, key: str, as_of: dt.date | None = None, within_days: int | None = None) -> DataFrame:
    """Earlier findings with this key, most recent first."""
    found = findings.filter(F.col("key") == key)
    if as_of is not None and within_days is not None:
        age = F.date_diff(F.lit(as_of), F.col("as_of"))
        found = found.filter(age.between(0, within_days))
    return found.orderBy(F.col("as_of").desc())


def latest_prior(df: DataFrame, findings: DataFrame, within_days: int, key: str = "key", as_of: str = "as_of") -> DataFrame:
    """Adds ``prior_as_of``: the latest finding with the same key at most ``within_days`` old.

    Findings are reduced to one row per key and day, each day is carried to the
    ``within_days`` days that still see it, and only the latest survives. The
    join is then one row to one, whatever number of findings a key has.
    """
    days = findings.select(F.col("key").alias("prior_key"), F.col("as_of").alias("prior_as_of")).distinct()
    seen = days.select(
        "prior_key", "prior_as_of",
        F.explode(F.sequence("prior_as_of", F.date_add("prior_as_of", within_days))).alias("seen_on"),
    )
    latest = seen.groupBy("prior_key", "seen_on").agg(F.max("prior_as_of").alias("prior_as_of"))
    match = (F.col(key) == F.col("prior_key")) & (F.col(as_of) == F.col("seen_on"))
    return df.join(latest, match, "left").drop("prior_key", "seen_on")


def suppress(
    judged: DataFrame, findings: DataFrame, calendar: DataFrame, as_of: Column | str,
    repeat_window_days: int = REPEAT_WINDOW_DAYS,
) -> DataFrame:
    """Adds ``key, season, prior_as_of, status, suppressed`` to judged diagnoses.

    The first reason that holds is the status: SEASONAL, REFUTED, IMMATERIAL,
    REPEAT, else NEW. A finding dated after ``as_of`` does not count as a repeat.
    """
    as_of = F.col(as_of) if isinstance(as_of, str) else as_of
    keyed = judged.withColumn("as_of", as_of.cast("date")).withColumn("key", finding_key("dominant", top_driver()))
    known = latest_prior(event_for_week(keyed, "w1", calendar), findings, repeat_window_days)
    status = (
        F.when(F.col("season").isNotNull(), "SEASONAL")
        .when(F.col("verdict") == "REFUTE", "REFUTED")
        .when(F.abs("delta") < MATERIALITY, "IMMATERIAL")
        .when(F.col("prior_as_of").isNotNull(), "REPEAT")
        .otherwise("NEW")
    )
    return known.withColumn("status", status).withColumn("suppressed", F.col("status") != "NEW")


def drop_acknowledged(candidates: DataFrame, suppressions: DataFrame, now: dt.datetime | dt.date) -> DataFrame:
    """Candidates without an unexpired entry for (metric, dimension_slice, root_cause_label)."""
    active = suppressions.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now)))
    keys = ["metric", "dimension_slice", "root_cause_label"]
    return candidates.join(active.select(*keys).distinct(), keys, "left_anti")


def similar_findings(
    memory: DataFrame, candidate: Column, as_of: dt.date, k: int = 10,
    vector: str = "embedding", reported: str = "as_of", decay_days: float = PRIOR_DECAY_DAYS, key: str = "vec_id",
) -> DataFrame:
    """The k remembered findings closest to ``candidate``, older ones counting less.

    Cosine similarity times exp(-age / decay); one scan and a distributed top-k.
    Equal scores are ordered by ``key``.
    """
    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    v = F.col(vector)
    paired = memory.filter(F.col(reported) <= F.lit(as_of)).withColumn("candidate", candidate)
    c = F.col("candidate")
    scored = paired.withColumn("similarity", safe_divide(dot(v, c), F.sqrt(dot(v, v)) * F.sqrt(dot(c, c))))
    age = F.date_diff(F.lit(as_of), F.col(reported))
    return (
        scored.withColumn("age_days", age)
        .withColumn("score", F.col("similarity") * F.exp(-F.col("age_days") / decay_days))
        .drop("candidate", vector)
        .orderBy(F.col("score").desc(), key).limit(k)
    )


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows, scaled to length 1; a zero vector stays zero."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(size == 0, 1.0, size)[:, None]


def _best_in_blocks(k: int, decay_days: float):
    """Compares a block of candidates with a block of memory; keeps the k best of each candidate."""
    def compare(candidates: pa.Table, memory: pa.Table) -> pa.Table:
        names = ["candidate_id", "prior_id", "similarity", "score"]
        if not len(candidates) or not len(memory):
            return pa.table({n: pa.array([], pa.int64() if n.endswith("_id") else pa.float64()) for n in names})
        asked, held = _vectors(candidates["vector"]), _vectors(memory["vector"])
        ids, prior = candidates["id"].to_numpy(), memory["id"].to_numpy()
        day, reported = (t["day"].to_numpy().astype(np.int64) for t in (candidates, memory))
        out = []
        for i in range(len(ids)):
            similarity = np.einsum("ij,j->i", held, asked[i])
            age = day[i] - reported
            score = np.where((age >= 0) & (prior != ids[i]), similarity * np.exp(-age / decay_days), -np.inf)
            # ranks go by 12 digits, as in the merge
            best = np.lexsort([prior, -np.round(score, 12)])[:k]
            best = best[np.isfinite(score[best])]
            out.append((np.full(len(best), ids[i]), prior[best], similarity[best], score[best]))
        return pa.table({n: np.concatenate(c) for n, c in zip(names, zip(*out))})

    return compare


def recall_similar(
    memory: DataFrame, candidates: DataFrame, k: int = 10, decay_days: float = PRIOR_DECAY_DAYS,
    key: str = "vec_id", vector: str = "embedding", reported: str = "as_of",
) -> DataFrame:
    """candidate_id, prior_rank, prior_id, similarity, score: the k remembered findings closest to each candidate.

    Scores are those of ``similar_findings``, each candidate as of its own day;
    it never finds itself. Both sides come in blocks by hash of their key; each
    block of candidates meets each block of memory in a task of its own, which
    hands on k rows a candidate, so what is merged is bounded by candidates x k
    x blocks of memory. Rows without a vector or a day take no part.
    """
    def block(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
        used = rows.filter(F.col(vector).isNotNull() & F.col(reported).isNotNull())
        n = max(1, -(-used.count() // size))
        of = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        return used.select(of.alias("own"), F.col(key).alias("id"), F.col(vector).alias("vector"), F.unix_date(reported).cast("long").alias("day")), n

    asked, n_asked = block(candidates, CANDIDATE_BLOCK)
    held, n_held = block(memory, MEMORY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(F.col("own").alias("a"), every(n_held).alias("b"), "id", "vector", "day")
    held = held.select(every(n_asked).alias("a"), F.col("own").alias("b"), "id", "vector", "day")
    best = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInArrow(
        _best_in_blocks(k, decay_days), "candidate_id long, prior_id long, similarity double, score double")
    order = Window.partitionBy("candidate_id").orderBy(F.round("score", 12).desc(), "prior_id")
    ranked = best.withColumn("prior_rank", F.row_number().over(order)).filter(F.col("prior_rank") <= k)
    return ranked.select("candidate_id", "prior_rank", "prior_id", "similarity", "score")
