"""Mergeable state of sessions in the state store of a stream.

A session's state is the partial row that its events so far reduce to: the
smallest day, the largest value of each attribute, the furthest step, and the
largest revenue of each transaction. Partial rows of new events merge into it,
in any order and at any age. Every merge gives the session's row before and
after, with signs, so that whatever is summed over sessions follows by adding.
A micro-batch thus reads its own events and the states of its own sessions.

The store keeps sessions in pages: a page holds the sessions of one range of
``ga_session_id`` (a day, where ids are seconds) that share a hash. A page is
read and written as one value, which costs about as much as one session alone,
so a batch costs as many calls as it touches pages, however many sessions they
hold.

Tasks reduce their events to a row for each (session, transaction) before the
shuffle, so a session with very many events reaches its state as a few rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from funnelspark.functions.events import channel_group, reached_flags, step_rank
from funnelspark.functions.numeric import money
from funnelspark.operators.sessions import SESSION, with_session

LARGEST = (
    "event_source", "first_touch_source", "event_medium", "first_touch_medium", "gclid", "device_category", "country",
)
PARTIAL = "session_date date, {}, furthest_step int, is_new_user boolean".format(", ".join(f"{c} string" for c in LARGEST))
REDUCED = f"user_pseudo_id string, ga_session_id long, transaction_id string, {PARTIAL}, cents long"
PAGE = "page binary"
CHANGE = f"sign int, {PARTIAL}, cents long"
#: Pages of a range of session ids, and the width of a range. Both are part of the state: a stream keeps those it began with.
PAGES, RANGE = 8192, 86_400
_NAMES = ("session_date", *LARGEST, "furthest_step", "is_new_user")


def partial_rows(stg: DataFrame) -> DataFrame:
    """The columns of staged events that make up partial rows; revenue in cents."""
    return with_session(stg).select(
        *SESSION, "transaction_id", F.col("event_date").alias("session_date"), *LARGEST, step_rank().alias("furthest_step"),
        F.coalesce(F.col("ga_session_number") == 1, F.lit(False)).alias("is_new_user"),
        (money("purchase_revenue_in_usd") * 100).cast("long").alias("cents"),
    )


def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial rows -> one for each session and transaction of a batch."""
    keys = [*SESSION, "transaction_id"]
    how = [("session_date", "min"), *((c, "max") for c in (*LARGEST, "furthest_step", "is_new_user", "cents"))]
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.set_column(table.column_names.index("is_new_user"), "is_new_user", table["is_new_user"].cast(pa.int8()))
        out = table.group_by(keys, use_threads=False).aggregate(how)
        out = out.rename_columns([c.removesuffix("_min").removesuffix("_max") if c not in keys else c for c in out.column_names])
        out = out.set_column(out.column_names.index("is_new_user"), "is_new_user", out["is_new_user"].cast(pa.bool_()))
        yield from out.select([*SESSION, "transaction_id", *_NAMES, "cents"]).combine_chunks().to_batches()


def _larger(a, b):
    return a if b is None or (a is not None and a >= b) else b


def _smaller(a, b):
    return a if b is None or (a is not None and a <= b) else b


def merged(before: tuple | None, rows: Iterator[tuple]) -> tuple:
    """State after the partial rows (transaction, *_NAMES, cents); merging is associative and commutative."""
    values = list(before[:-2]) if before else [None] * len(_NAMES)
    paid = dict(zip(before[-2], before[-1])) if before else {}
    for transaction, *new, cents in rows:
        values = [_smaller(values[0], new[0]), *map(_larger, values[1:], new[1:])]
        if cents is not None:
            paid[transaction] = _larger(paid.get(transaction), cents)
    order = sorted(paid, key=lambda t: (t is not None, t))
    return (*values, order, [paid[t] for t in order])


def _cells(column: pd.Series) -> list:
    """Values of a pandas column: missing ones are None, numbers plain; a nullable whole number travels as a float."""
    if column.dtype.kind == "f":
        return [None if v != v else int(v) for v in column.tolist()]
    return [None if v is None or v is pd.NaT or v != v else v for v in column.tolist()]


def changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge a batch's partial rows into the sessions of a page; gives the row of each that changed before (sign -1) and after (sign 1)."""
    held = pickle.loads(state.get[0]) if state.exists else {}
    before = {}
    for frame in frames:
        columns = [_cells(frame[c]) for c in (*SESSION, "transaction_id", *_NAMES, "cents")]
        new = {}
        for session, *row in zip(zip(*columns[:2]), *columns[2:]):
            new.setdefault(session, []).append(row)
        for session, rows in new.items():
            before.setdefault(session, held.get(session))
            held[session] = merged(held.get(session), iter(rows))
    signed = [
        (sign, *row[:-2], sum(row[-1]))
        for session, old in before.items() if old != held[session]
        for sign, row in ((-1, old), (1, held[session])) if row
    ]
    if not signed:
        return
    state.update((pickle.dumps(held, protocol=5),))
    yield pd.DataFrame(signed, columns=["sign", *_NAMES, "cents"])


def session_changes(stg: DataFrame) -> DataFrame:
    """A stream of staged events -> signed session rows with channel, flags and revenue."""
    reduced = partial_rows(stg).mapInArrow(reduce_rows, REDUCED)
    paged = reduced.withColumns({"id_range": F.floor(F.col("ga_session_id") / RANGE), "page": F.pmod(F.xxhash64(*SESSION), F.lit(PAGES))})
    signed = paged.groupBy("id_range", "page").applyInPandasWithState(changes, CHANGE, PAGE, "update", GroupStateTimeout.NoTimeout)
    source, medium = F.coalesce("event_source", "first_touch_source"), F.coalesce("event_medium", "first_touch_medium")
    return signed.select(
        "sign", F.col("session_date").alias("event_date"), channel_group(source, medium, "gclid").alias("channel_group"), "device_category", "country",
        "is_new_user", *reached_flags(), (F.col("cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("session_revenue"),
    )
