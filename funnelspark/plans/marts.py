"""The tables of one test-data folder, each built from raw events on first use."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from funnelspark.operators import cohorts, daily, orders, sessions, staging
from funnelspark.session import materialize
from funnelspark.sources import testtables
from funnelspark.sources.marts import read_mart, write_mart


class Marts(Mapping):
    """Lazy DataFrames; the mapping holds those a metric request can name."""

    METRIC_TABLES = {
        "fct_funnel": "funnel", "fct_sessions": "sessions", "fct_orders": "orders", "buyer_orders": "buyer_orders",
        "fct_cohorts": "cohorts", "fct_order_items": "item_lines", "session_items": "view_lines",
        "cohort_users": "cohort_users",
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, self.METRIC_TABLES[name])

    def __iter__(self) -> Iterator[str]:
        return iter(self.METRIC_TABLES)

    def __len__(self) -> int:
        return len(self.METRIC_TABLES)

    def table(self, name: str) -> DataFrame:
        return testtables.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return testtables.raw_events(self.spark, self.sf_dir)

    @cached_property
    def raw_with_items(self) -> DataFrame:
        return testtables.raw_events(self.spark, self.sf_dir, items=True)

    @cached_property
    def stg(self) -> DataFrame:
        return staging.stg_events(self.raw)

    @cached_property
    def rollup(self) -> DataFrame:
        return sessions.session_rollup(self.stg)

    @cached_property
    def funnel(self) -> DataFrame:
        return sessions.funnel_facts(self.rollup)

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.fct_sessions(self.rollup)

    def share_sessions(self) -> "Marts":
        """Write the session table once, for a query that reads it in several branches."""
        facts = sessions.funnel_facts(self.rollup).columns
        self.sessions = materialize(sessions.fct_sessions(self.rollup), "sessions")
        self.funnel = self.sessions.select(*facts)
        return self

    def share_orders(self) -> "Marts":
        """The same for the orders, which buyer counts are joined back to."""
        self.orders = materialize(orders.fct_orders(self.raw, self.funnel), "orders")
        return self

    @cached_property
    def daily(self) -> DataFrame:
        return daily.fct_daily_funnel(self.funnel)

    @cached_property
    def weekly(self) -> DataFrame:
        """Weekly funnel, written once: several branches of a diagnosis read it."""
        return materialize(daily.weekly_funnel(self.funnel), "weekly-funnel")

    @cached_property
    def orders(self) -> DataFrame:
        return orders.fct_orders(self.raw, self.funnel)

    @cached_property
    def buyer_orders(self) -> DataFrame:
        return orders.with_order_counts(self.orders)

    @cached_property
    def order_items(self) -> DataFrame:
        return orders.fct_order_items(self.raw_with_items, self.funnel)

    @cached_property
    def view_lines(self) -> DataFrame:
        return orders.item_view_lines(self.raw_with_items, self.funnel)

    @cached_property
    def item_lines(self) -> DataFrame:
        return orders.item_lines(self.order_items, self.view_lines)

    @cached_property
    def cohort_users(self) -> DataFrame:
        return cohorts.user_days(self.sessions)

    @cached_property
    def cohorts(self) -> DataFrame:
        return cohorts.fct_cohorts(self.sessions)


def build_marts(marts: Marts, root: str, names: tuple[str, ...] = tuple(Marts.METRIC_TABLES)) -> "StoredMarts":
    """Write the tables that metric requests read under ``root``, in day partitions where they have days.

    Sessions are built once and read by what is built on them. A table that is
    there already is replaced.
    """
    marts.share_sessions()
    for name in names:
        table = marts[name]
        write_mart(table, f"{root.rstrip('/')}/{name}", "event_date" if "event_date" in table.columns else None)
    return StoredMarts(marts.spark, root, names)


class StoredMarts(Mapping):
    """Tables written by ``build_marts``; a metric request on them reads no raw event."""

    def __init__(self, spark: SparkSession, root: str, names: tuple[str, ...] = tuple(Marts.METRIC_TABLES)):
        self.spark, self.root, self.names = spark, root.rstrip("/"), names

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return read_mart(self.spark, f"{self.root}/{name}")

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)
