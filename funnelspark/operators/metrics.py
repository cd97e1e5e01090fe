"""Governed metrics: 49 named measures over 19 dimensions.

A metric is a small formula over parts; a part is a count, a sum or a distinct
count with an optional condition. ``metric_query`` computes the parts of all
asked metrics together, one grouped aggregation per source table, and then the
formulas, so a ratio is always a ratio of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import all_of, time_grain, typed_literal
from funnelspark.functions.numeric import money, safe_divide
from funnelspark.operators.cohorts import cohorts_of


class SemanticError(ValueError):
    """A request that names something ungoverned or mixes what cannot be mixed."""


# ── dimensions ────────────────────────────────────────────────────────────────

TIME_DIMS = ("day", "week", "month", "quarter")
ITEM_DIMS = ("item_name", "item_category", "item_brand")
PLAIN_DIMS = (
    "is_new_user", "country", "region", "device_category", "browser", "operating_system", "source", "medium",
    "campaign", "channel_group", *ITEM_DIMS, "landing_page", "session_number_bucket",
)
DIMENSIONS: dict[str, Callable[[], Column]] = {
    **{d: (lambda d=d: time_grain("event_date", d)) for d in TIME_DIMS},
    **{d: (lambda d=d: F.col(d)) for d in PLAIN_DIMS},
}


def _dimension(name: str) -> Column:
    if name not in DIMENSIONS:
        raise SemanticError(f"{name!r} is not a governed dimension")
    return DIMENSIONS[name]()


# Dimension lists by rule: a common core, wider for sessions, narrower elsewhere.
CORE = frozenset({*TIME_DIMS, "channel_group", "device_category", "country", "source", "medium", "campaign", "is_new_user"})
SESSION = CORE | {"browser", "operating_system", "region", "landing_page", "session_number_bucket"}
ACQUISITION = CORE - {"is_new_user"}
COHORT = CORE - {"day"}
PRODUCT = frozenset({*TIME_DIMS, *ITEM_DIMS, "channel_group", "device_category", "country"})


# ── parts and formulas ────────────────────────────────────────────────────────

Condition = Callable[[], Column]


@dataclass(frozen=True)
class Part:
    """One aggregate: kind 'count', 'sum', 'money' or 'distinct' of a column.

    ``over_all_items`` asks for the aggregate over the whole request scope, with
    item dimensions and item filters left out.
    """

    kind: str
    column: str | None = None
    when: Condition | None = None
    label: str = ""
    source: str | None = None
    over_all_items: bool = False

    @property
    def name(self) -> str:
        scope = "_all" if self.over_all_items else ""
        return "_".join(x for x in ("part", self.source, self.kind, self.column, self.label) if x) + scope


@dataclass(frozen=True)
class Ratio:
    num: "Formula"
    den: "Formula"


@dataclass(frozen=True)
class Share:
    """A part divided by its total over all result rows."""

    part: Part


Formula = Part | Ratio | Share


@dataclass(frozen=True)
class Metric:
    name: str
    grain: str
    dims: frozenset[str]
    formula: Formula


def _parts(formula: Formula) -> list[Part]:
    if isinstance(formula, Part):
        return [formula]
    if isinstance(formula, Share):
        return [formula.part]
    return _parts(formula.num) + _parts(formula.den)


def _bind(formula: Formula, source: str) -> Formula:
    """Fill in the source table of parts that do not name their own."""
    if isinstance(formula, Part):
        return formula if formula.source else replace(formula, source=source)
    if isinstance(formula, Share):
        return Share(_bind(formula.part, source))
    return Ratio(_bind(formula.num, source), _bind(formula.den, source))


def _flag(column: str) -> Condition:
    return lambda: F.col(column)


def flagged(column: str) -> Part:
    return Part("count", None, _flag(column), column)


SESSIONS = Part("distinct", "session_key")
USERS = Part("distinct", "user_pseudo_id")
ORDERS = Part("distinct", "order_key")
REVENUE = Part("money", "session_revenue")
GROSS = Part("money", "gross_revenue")
NEW_USERS = Part("distinct", "user_pseudo_id", _flag("is_new_user"), "new")
RETURNING_USERS = Part("distinct", "user_pseudo_id", lambda: ~F.col("is_new_user"), "returning")
PURCHASING_USERS = Part("distinct", "user_pseudo_id", _flag("reached_purchase"), "purchasing")
NEW_PURCHASERS = Part(
    "distinct", "user_pseudo_id", lambda: F.col("is_new_user") & F.col("reached_purchase"), "new_purchasing"
)
# Channels that count as paid traffic in paid_sessions.
PAID_TRAFFIC = ("Paid Search", "Paid Social", "Display")
PAID_SESSIONS = Part("count", None, lambda: F.col("channel_group").isin(*PAID_TRAFFIC), "paid")
ENGAGED = flagged("engaged_session")
VIEWED, CARTED, CHECKOUT = flagged("reached_view_item"), flagged("reached_add_to_cart"), flagged("reached_begin_checkout")
SHIPPING, PAYMENT, PURCHASED = (
    flagged("reached_add_shipping_info"), flagged("reached_add_payment_info"), flagged("reached_purchase")
)


def buyers(at_least: int) -> Part:
    return Part(
        "distinct", "buyer_user_id", lambda: F.col("user_order_count") >= at_least, f"orders_{at_least}",
        source="buyer_orders",
    )


def retained(days: int) -> Part:
    return Part("sum", f"retained_users_d{days}")


COHORT_SIZE = Part("sum", "cohort_size")
ITEM_SESSIONS = Part("distinct", "session_key", _flag("item_viewed_in_session"), "viewed", source="session_items")
ITEM_ORDERS = Part("distinct", "order_key", _flag("item_in_order"), "with_item")
ALL_VIEWED = replace(VIEWED, source="fct_funnel", over_all_items=True)
ALL_ORDERS = replace(ORDERS, source="fct_orders", over_all_items=True)

_FUNNEL: dict[str, tuple[Formula, frozenset[str]]] = {
    "revenue": (REVENUE, SESSION),
    "revenue_per_user": (Ratio(REVENUE, USERS), CORE),
    "revenue_per_session": (Ratio(REVENUE, SESSIONS), SESSION),
    "users": (USERS, SESSION),
    "new_users": (NEW_USERS, SESSION),
    "returning_users": (RETURNING_USERS, SESSION),
    "sessions": (SESSIONS, SESSION),
    "view_item_sessions": (VIEWED, SESSION),
    "add_to_cart_sessions": (CARTED, SESSION),
    "begin_checkout_sessions": (CHECKOUT, SESSION),
    "add_shipping_info_sessions": (SHIPPING, SESSION),
    "add_payment_info_sessions": (PAYMENT, SESSION),
    "purchasing_sessions": (PURCHASED, SESSION),
    "view_to_cart_rate": (Ratio(CARTED, VIEWED), SESSION),
    "cart_to_checkout_rate": (Ratio(CHECKOUT, CARTED), SESSION),
    "checkout_to_purchase_rate": (Ratio(PURCHASED, CHECKOUT), SESSION),
    "session_conversion_rate": (Ratio(PURCHASED, SESSIONS), SESSION),
    "user_conversion_rate": (Ratio(PURCHASING_USERS, USERS), SESSION),
    "purchasing_users": (PURCHASING_USERS, SESSION),
    "channel_conversion_rate": (Ratio(PURCHASED, SESSIONS), SESSION - {"session_number_bucket"}),
    "cac_proxy": (Ratio(PAID_SESSIONS, NEW_PURCHASERS), ACQUISITION),
    "traffic_share": (Share(SESSIONS), SESSION),
    "paid_sessions": (PAID_SESSIONS, ACQUISITION | {"region"}),
    "new_purchasers": (NEW_PURCHASERS, ACQUISITION | {"region"}),
    "product_view_rate": (Ratio(ITEM_SESSIONS, ALL_VIEWED), PRODUCT),
    "item_view_sessions": (ITEM_SESSIONS, PRODUCT),
}
_SESSIONS: dict[str, tuple[Formula, frozenset[str]]] = {
    "engaged_sessions": (ENGAGED, SESSION),
    "engagement_rate": (Ratio(ENGAGED, SESSIONS), SESSION),
}
_ORDERS: dict[str, tuple[Formula, frozenset[str]]] = {
    "orders": (ORDERS, CORE),
    "gross_revenue": (GROSS, CORE),
    "net_revenue": (Part("money", "net_revenue"), CORE),
    "aov": (Ratio(GROSS, ORDERS), CORE),
    "repeat_purchase_rate": (Ratio(buyers(2), buyers(1)), CORE),
    "purchasers": (buyers(1), CORE),
    "repeat_purchasers": (buyers(2), CORE),
    "channel_revenue": (GROSS, CORE | {"region"}),
}
_COHORTS: dict[str, tuple[Formula, frozenset[str]]] = {
    "day_1_retention": (Ratio(retained(1), COHORT_SIZE), COHORT),
    "day_7_retention": (Ratio(retained(7), COHORT_SIZE), COHORT),
    "day_30_retention": (Ratio(retained(30), COHORT_SIZE), COHORT),
    "cohort_size": (COHORT_SIZE, COHORT - {"is_new_user"}),
    "retained_users_d1": (retained(1), COHORT - {"is_new_user"}),
    "retained_users_d7": (retained(7), COHORT - {"is_new_user"}),
    "retained_users_d30": (retained(30), COHORT - {"is_new_user"}),
}
_ITEMS: dict[str, tuple[Formula, frozenset[str]]] = {
    "product_revenue": (Part("money", "item_revenue_in_usd"), PRODUCT),
    "product_conversion_rate": (Ratio(Part("sum", "item_purchases"), Part("sum", "item_views")), PRODUCT),
    "product_attach_rate": (Ratio(ITEM_ORDERS, ALL_ORDERS), PRODUCT),
    "item_views": (Part("sum", "item_views"), PRODUCT),
    "item_purchases": (Part("sum", "item_purchases"), PRODUCT),
    "orders_with_item": (ITEM_ORDERS, PRODUCT),
}

METRICS: dict[str, Metric] = {
    name: Metric(name, grain, dims, _bind(formula, grain))
    for grain, group in (
        ("fct_funnel", _FUNNEL), ("fct_sessions", _SESSIONS), ("fct_orders", _ORDERS),
        ("fct_cohorts", _COHORTS), ("fct_order_items", _ITEMS),
    )
    for name, (formula, dims) in group.items()
}

# Key that is unique in a table: its distinct count is a plain row count.
UNIQUE_KEYS = {"fct_funnel": "session_key", "fct_sessions": "session_key", "fct_orders": "order_key"}


# ── filters ───────────────────────────────────────────────────────────────────

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class Filter:
    dimension: str
    op: str
    value: object

    def condition(self) -> Column:
        column, op = _dimension(self.dimension), self.op.upper()
        if op in _COMPARE:
            return _COMPARE[op](column, self._literal(self.value))
        if op == "BETWEEN":
            low, high = self.value
            return column.between(self._literal(low), self._literal(high))
        if op == "IN":
            return column.isin(*[self._literal(v) for v in self.value])
        if op == "NOT IN":
            return ~column.isin(*[self._literal(v) for v in self.value])
        raise SemanticError(f"unsupported filter op {self.op!r}")

    def _literal(self, value) -> Column:
        try:
            return typed_literal(value, self.dimension in TIME_DIMS)
        except ValueError as error:
            raise SemanticError(f"{value!r} is not a date, which {self.dimension} asks for") from error


# ── bridges ───────────────────────────────────────────────────────────────────

@dataclass(frozen=True)
class Bridge:
    """How rows of a table reach filter dimensions that the table lacks.

    Rows of ``base`` are kept whose ``key`` belongs to a row of another table
    that meets all filters on it together: a session for its dimensions, a
    viewed or bought line for those of items. The keys are joined as a
    semi-join, ahead of any aggregation; Spark puts a Bloom filter of the keys
    before the scan where it pays. ``build`` makes the asked table of the rows
    that are left.
    """

    base: str
    session: str = "session_key"
    item: str = "session_key"
    build: Callable[[DataFrame], DataFrame] = lambda rows: rows


BRIDGES = {
    "fct_funnel": Bridge("fct_funnel"),
    "fct_sessions": Bridge("fct_sessions"),
    "fct_orders": Bridge("fct_orders", item="order_key"),
    "buyer_orders": Bridge("buyer_orders", item="order_key"),
    "fct_order_items": Bridge("fct_order_items"),
    "session_items": Bridge("session_items"),
    # a cohort has the dimensions of its users' first sessions
    "fct_cohorts": Bridge("cohort_users", build=cohorts_of),
}


def _bridged(tables: Mapping[str, DataFrame], source: str, absent: list[tuple[str, Column]]) -> DataFrame:
    """The table with filters on dimensions of other tables applied."""
    bridge = BRIDGES[source]
    try:
        rows = tables[bridge.base]
        for via, key, items in (("fct_sessions", bridge.session, False), ("fct_order_items", bridge.item, True)):
            conditions = [c for d, c in absent if (d in ITEM_DIMS) == items]
            if conditions:
                rows = rows.join(tables[via].filter(all_of(conditions)).select(key), key, "left_semi")
    except KeyError as error:
        raise SemanticError(f"metrics of {source} cannot be filtered by {absent[0][0]} without the table {error.args[0]}") from error
    return bridge.build(rows)


# ── query ─────────────────────────────────────────────────────────────────────

def _validate(metrics: Sequence[str], dims: Sequence[str]) -> list[Metric]:
    if not metrics:
        raise SemanticError("at least one metric is needed")
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise SemanticError(f"{unknown[0]!r} is not a governed metric")
    chosen = [METRICS[m] for m in metrics]
    for d in dims:
        _dimension(d)
        refusing = [m.name for m in chosen if d not in m.dims]
        if refusing:
            raise SemanticError(f"{refusing[0]} cannot be grouped by {d}")
    grains = {m.grain for m in chosen}
    if len(grains) > 1:
        raise SemanticError(f"metrics of different grains in one request: {sorted(grains)}")
    return chosen


def _partial(part: Part) -> Column:
    """First-level aggregate of a part within one key; distinct parts become a flag."""
    condition = part.when() if part.when else None
    if part.kind == "distinct":
        return F.bool_or(F.coalesce(condition, F.lit(False))) if condition is not None else F.bool_or(F.lit(True))
    return _direct(part)


def _direct(part: Part) -> Column:
    condition = part.when() if part.when else None
    if part.kind == "count":
        return F.count_if(condition) if condition is not None else F.count(F.lit(1))
    value = money(part.column) if part.kind == "money" else F.col(part.column)
    if condition is not None:
        value = F.when(condition, value)
    if part.kind == "distinct":
        return F.count_distinct(value)
    return F.sum(value)


def _row_count(part: Part) -> Part:
    """A distinct count over a unique key as a row count of its non-NULL values."""
    def condition() -> Column:
        present = F.col(part.column).isNotNull()
        return present & part.when() if part.when else present

    return replace(part, kind="count", when=condition)


def _aggregate(table: DataFrame, source: str, dims: list[Column], names: list[str], parts: list[Part], trust_grain: bool) -> DataFrame:
    """All parts of one table by ``dims``.

    When the distinct counts share one key, rows are first reduced per (dims,
    key) and the flags of a key are counted afterwards. Spark's own plan for
    several distinct counts copies every row once per count instead.
    """
    def plan(p: Part) -> Part:
        unique = trust_grain and p.kind == "distinct" and UNIQUE_KEYS.get(source) == p.column
        return _row_count(p) if unique else p

    planned = [(p.name, plan(p)) for p in parts]
    keys = {p.column for _, p in planned if p.kind == "distinct"}
    keyed = table.select("*", *[c.alias(f"dim_{n}") for c, n in zip(dims, names)])
    group = [f"dim_{n}" for n in names]
    if len(keys) != 1:
        result = keyed.groupBy(*group).agg(*[_direct(p).alias(name) for name, p in planned])
    else:
        (key,) = keys
        per_key = keyed.withColumn("entity", F.col(key)).groupBy(*group, "entity").agg(
            *[_partial(p).alias(name) for name, p in planned]
        )
        totals = [
            (F.count_if(F.col(name) & F.col("entity").isNotNull()) if p.kind == "distinct" else F.sum(name)).alias(name)
            for name, p in planned
        ]
        result = per_key.groupBy(*group).agg(*totals)
    return result.select(
        *[F.col(f"dim_{n}").alias(n) for n in names],
        *[(F.col(name).cast("double") if p.kind == "money" else F.col(name)).alias(name) for name, p in planned],
    )


def _join_on(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on dimension values, a missing value equal to itself."""
    if not names:
        # one total row: read as scalars, so there is nothing to join
        return left.select("*", *[right.select(c).scalar().alias(c) for c in right.columns])
    renamed = right.withColumnsRenamed({n: f"right_{n}" for n in names})
    on = all_of([F.col(n).eqNullSafe(F.col(f"right_{n}")) for n in names])
    return left.join(renamed, on, "left").drop(*[f"right_{n}" for n in names])


def _combine(frames: list[DataFrame], names: Sequence[str], parts: list[Part]) -> DataFrame:
    """Rows of several sources side by side: stacked, then one row per group."""
    if len(frames) == 1:
        return frames[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    merged = stacked.groupBy(*names).agg(*[F.max(p.name).alias(p.name) for p in parts])
    counts = [p.name for p in parts if p.kind in ("count", "distinct")]
    return merged.fillna(0, counts) if counts else merged


def _evaluate(formula: Formula, totals: Mapping[str, Column]) -> Column:
    if isinstance(formula, Part):
        return F.col(formula.name)
    if isinstance(formula, Share):
        return safe_divide(formula.part.name, totals[formula.part.name])
    return safe_divide(_evaluate(formula.num, totals), _evaluate(formula.den, totals))


def metric_query(
    tables: Mapping[str, DataFrame],
    metrics: Sequence[str],
    dims: Sequence[str] = (),
    filters: Sequence[Filter | dict] = (),
    order_by_time: bool = True,
    trust_grain: bool = True,
) -> DataFrame:
    """The asked metrics by the asked dimensions.

    ``tables`` maps table names to DataFrames; only those a metric needs are
    read. Filters apply before grouping and may use any governed dimension; one
    that a table lacks is looked up through a bridge.
    ``trust_grain=False`` counts keys as distinct even where they are unique.
    """
    chosen = _validate(metrics, dims)
    filters = [f if isinstance(f, Filter) else Filter(**f) for f in filters]
    conditions = [(f.dimension, f.condition()) for f in filters]

    parts = {p.name: p for m in chosen for p in _parts(m.formula)}
    groups: dict[tuple[str, bool], list[Part]] = {}
    for p in parts.values():
        groups.setdefault((p.source, p.over_all_items), []).append(p)

    def frame(source: str, over_all_items: bool, group: list[Part]) -> tuple[list[str], DataFrame]:
        skip = ITEM_DIMS if over_all_items else ()
        have = set(tables[source].columns)
        absent = [(d, c) for d, c in conditions if d not in skip and d not in TIME_DIMS and d not in have]
        kept = [c for d, c in conditions if d not in skip and (d in TIME_DIMS or d in have)]
        names = [d for d in dims if d not in skip]
        table = _bridged(tables, source, absent) if absent else tables[source]
        table = table.filter(all_of(kept)) if kept else table
        return names, _aggregate(table, source, [_dimension(d) for d in names], names, group, trust_grain)

    main = [frame(source, False, group)[1] for (source, scoped), group in groups.items() if not scoped]
    result = _combine(main, dims, [p for p in parts.values() if not p.over_all_items])
    for (source, scoped), group in groups.items():
        if scoped:
            names, right = frame(source, True, group)
            result = _join_on(result, right, names)

    shares = {m.formula.part.name for m in chosen if isinstance(m.formula, Share)}
    # The total is one value computed from the grouped rows. A window without
    # partitions would pull all of them into a single task.
    totals = {name: result.select(F.sum(name)).scalar() for name in shares}
    output = result.select(*dims, *[_evaluate(m.formula, totals).alias(m.name) for m in chosen])
    time_dims = [d for d in dims if d in TIME_DIMS]
    return output.orderBy(*time_dims) if order_by_time and time_dims else output
