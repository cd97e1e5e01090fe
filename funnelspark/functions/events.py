"""Column functions over raw and staged events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Value slot per parameter type.
PARAM_SLOTS = {"string": "string_value", "int": "int_value", "float": "float_value", "double": "double_value"}

# The six funnel steps from first to last.
FUNNEL_STEPS = ("view_item", "add_to_cart", "begin_checkout", "add_shipping_info", "add_payment_info", "purchase")
REACHED = tuple(f"reached_{step}" for step in FUNNEL_STEPS)

# Thresholds of the engaged-session rule.
ENGAGED_MSEC = 10000

# Names and patterns of the channel rules.
DIRECT_SOURCES = ("(direct)", "direct")
DIRECT_MEDIUMS = ("(none)", "(not set)")
SEARCH_SOURCES = r"google|bing|yahoo|duckduckgo|baidu|yandex|ecosia"
SOCIAL_SOURCES = r"facebook|instagram|tiktok|twitter|x\.com|linkedin|pinterest|reddit|snapchat"
PAID_SEARCH_MEDIUMS = r"^(.*cp.*|ppc|paid|retargeting)$"
PAID_SOCIAL_MEDIUMS = r"^(.*cp.*|ppc|paid|social-paid|retargeting)$"
DISPLAY_MEDIUMS = r"^(display|banner|cpm|expandable|interstitial)$"
SOCIAL_MEDIUMS = ("social", "social-network", "social-media", "sm", "organic", "referral")
EMAIL_MEDIUMS = r"^e?-?mail$"
REFERRAL_MEDIUMS = ("referral", "link")

# Fixed value: text that stands for NULL inside a surrogate key.
SURROGATE_NULL = "_dbt_utils_surrogate_key_null_"


def event_param(key: str, kind: str = "string", params: str = "event_params") -> Column:
    """First value of a parameter, NULL when it is absent.

    Reads the key array and one value slot only, so the parquet scan prunes the
    other slots, and all of it compiles into generated code.
    """
    name = key.replace("\\", "\\\\").replace("'", "\\'")
    position = f"CAST(array_position({params}.key, '{name}') - 1 AS INT)"
    return F.expr(f"get({params}.value.{PARAM_SLOTS[kind]}, {position})")


def param_text(value: str = "value") -> Column:
    """The filled slot of a parameter value as text."""
    return F.coalesce(*[F.col(f"{value}.{slot}").cast("string") for slot in PARAM_SLOTS.values()])


def session_key(user: Column | str = "user_pseudo_id", session_id: Column | str = "ga_session_id") -> Column:
    """Hex md5 of user and session id; NULL when either is NULL."""
    user = F.col(user) if isinstance(user, str) else user
    session_id = F.col(session_id) if isinstance(session_id, str) else session_id
    return F.md5(F.concat(user, F.lit("-"), session_id.cast("string")))


def surrogate_key(*columns: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(SURROGATE_NULL)) for c in columns]
    return F.md5(F.concat_ws("-", *parts))


def channel_group(source: Column | str, medium: Column | str, gclid: Column | str) -> Column:
    """One of ten channels; the first matching rule wins."""
    gclid = F.col(gclid) if isinstance(gclid, str) else gclid
    s, m = F.lower(source), F.lower(medium)
    direct = (s.isNull() | s.isin(*DIRECT_SOURCES)) & (m.isNull() | m.isin(*DIRECT_MEDIUMS))
    rules = [
        ("Direct", direct),
        ("Paid Search", gclid.isNotNull() | (s.rlike(SEARCH_SOURCES) & m.rlike(PAID_SEARCH_MEDIUMS))),
        ("Paid Social", s.rlike(SOCIAL_SOURCES) & m.rlike(PAID_SOCIAL_MEDIUMS)),
        ("Display", m.rlike(DISPLAY_MEDIUMS)),
        ("Organic Search", s.rlike(SEARCH_SOURCES) & (m == "organic")),
        ("Organic Social", s.rlike(SOCIAL_SOURCES + "|youtube") & m.isin(*SOCIAL_MEDIUMS)),
        ("Email", (s == "email") | m.rlike(EMAIL_MEDIUMS)),
        ("Affiliates", m == "affiliate"),
        ("Referral", m.isin(*REFERRAL_MEDIUMS)),
    ]
    first, *rest = rules
    chain = F.when(first[1], first[0])
    for name, rule in rest:
        chain = chain.when(rule, name)
    return chain.otherwise("Other")


def step_rank(event_name: Column | str = "event_name") -> Column:
    """0 for an event outside the funnel, else 1 (view) to 6 (purchase)."""
    name = F.col(event_name) if isinstance(event_name, str) else event_name
    chain = F.when(name == FUNNEL_STEPS[0], 1)
    for rank, step in enumerate(FUNNEL_STEPS[1:], start=2):
        chain = chain.when(name == step, rank)
    return chain.otherwise(0)


def reached_flags(furthest: Column | str = "furthest_step") -> list[Column]:
    """The six flags of a session from its furthest step: a step implies all earlier ones."""
    furthest = F.col(furthest) if isinstance(furthest, str) else furthest
    return [(furthest >= rank).alias(name) for rank, name in enumerate(REACHED, start=1)]


def step_flags(event_name: Column | str = "event_name") -> list[Column]:
    """The six flags of one event: at or past each step."""
    return reached_flags(step_rank(event_name))


def engaged(session_engaged: str = "session_engaged", msec: str = "engagement_time_msec") -> Column:
    rule = (F.col(session_engaged) == "1") | (F.col(msec) >= ENGAGED_MSEC)
    return F.coalesce(rule, F.lit(False))


def time_grain(date: Column | str, grain: str) -> Column:
    """Date truncated to day, Monday week, month or quarter."""
    date = F.col(date) if isinstance(date, str) else date
    if grain == "day":
        return date
    if grain not in ("week", "month", "quarter"):
        raise ValueError(f"unknown time grain {grain!r}")
    return F.trunc(date, grain)


def session_number_bucket(n: Column | str = "ga_session_number") -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return (
        F.when(n <= 3, n.cast("string"))
        .when(n <= 6, "4-6")
        .when(n >= 7, "7+")
    )


def segment_label(*dims: Column | str) -> Column:
    """Dimension values joined by ' / '; a missing value reads 'None'."""
    cols = [F.col(d) if isinstance(d, str) else d for d in dims]
    return F.concat_ws(" / ", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])


def calendar_parts(date: Column | str = "event_date") -> list[Column]:
    date = F.col(date) if isinstance(date, str) else date
    weekday = F.dayofweek(date)
    return [
        F.year(date).alias("year"),
        F.quarter(date).alias("quarter"),
        F.month(date).alias("month"),
        F.weekofyear(date).alias("week"),
        weekday.alias("day_of_week"),
        F.date_format(date, "EEEE").alias("day_name"),
        weekday.isin(1, 7).alias("is_weekend"),
    ]


def typed_literal(value, is_date: bool | None = None) -> Column:
    """Literal of a filter value. A dimension says whether it is a date; a malformed one is a ValueError.

    Without that, text that looks like an ISO date is one.
    """
    looks_like = isinstance(value, str) and len(value) == 10 and value[4] == value[7] == "-"
    if isinstance(value, str) and (looks_like if is_date is None else is_date):
        return F.lit(dt.date.fromisoformat(value))
    return F.lit(value)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
