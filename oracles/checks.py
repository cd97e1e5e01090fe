"""Oracle SQL of the data checks."""

from oracles.common import COUNT_NAMES, FLAGS, ORACLES, ORDERS, STG, channel, div, money, r, sql, with_sessions
from oracles.marts import CHANNELS, DAILY

STATUS = "CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status"


def rule(name: str, table: str, broken: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) AS checked, count(CASE WHEN {broken} THEN 1 END) AS violations FROM {table}"


def union(*rules: str) -> str:
    return f"SELECT rule, checked, violations, {STATUS} FROM (" + "\nUNION ALL\n".join(rules) + ")"


ORACLES["check_not_null"] = with_sessions(union(
    rule("events.session_key", "stg", "ga_session_id IS NOT NULL AND session_key IS NULL"),
    *[rule(f"events.{c}", "stg", f"{c} IS NULL") for c in ("event_date", "event_timestamp", "user_pseudo_id")],
    *[rule(f"sessions.{c}", "fct", f"{c} IS NULL") for c in (
        "session_key", "event_date", "channel_group", "engaged_session", "is_new_user", "reached_purchase", "session_revenue")],
))


def unique(name: str, table: str, key: str) -> str:
    return f"""SELECT '{name}' AS rule, CAST(coalesce(sum(n), 0) AS BIGINT) AS checked, count(CASE WHEN n > 1 THEN 1 END) AS violations
 FROM (SELECT {key}, count(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY 1)"""


ORACLES["check_unique"] = with_sessions(union(
    unique("sessions.session_key", "fct", "session_key"), unique("daily.daily_funnel_key", "daily", "daily_funnel_key"),
    unique("orders.order_key", "ord", "order_key"), unique("raw.transaction_id", "stg", "transaction_id"),
), ORDERS, DAILY)
ORACLES["check_accepted_values"] = with_sessions(union(
    rule("sessions.channel_group", "fct", f"channel_group NOT IN (SELECT channel_group FROM {CHANNELS})"),
    rule("sessions.device_category without tablet", "fct", "device_category NOT IN ('mobile', 'desktop')"),
))
ORACLES["check_ranges"] = with_sessions(union(
    rule("orders.gross_revenue", "ord", "gross_revenue < 0"), rule("orders.net_revenue", "ord", "net_revenue < 0"),
    rule("orders.gross_revenue up to 100", "ord", "gross_revenue < 0 OR gross_revenue > 100"),
    rule("daily.sessions", "daily", "sessions < 0"),
), ORDERS, DAILY)
ORACLES["check_relationships"] = with_sessions(union(
    rule("sessions.channel_group", "fct", f"channel_group NOT IN (SELECT channel_group FROM {CHANNELS})"),
    rule("orders.channel_group", "ord", f"channel_group NOT IN (SELECT channel_group FROM {CHANNELS})"),
    rule("orders.session_key", "(SELECT * FROM ord WHERE session_key IS NOT NULL)", "session_key NOT IN (SELECT session_key FROM fct)"),
    rule("orders of customers in credit", "orders", "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
), ORDERS)
_falling = " OR ".join(f"{b} > {a}" for a, b in zip(COUNT_NAMES, COUNT_NAMES[1:]))
ORACLES["check_expression"] = with_sessions(union(
    rule("purchasing_sessions <= sessions", "daily", "NOT purchasing_sessions <= sessions"),
    rule("revenue >= 0", "daily", "NOT revenue >= 0"), rule("step counts fall", "daily", _falling),
), DAILY)
_monotonic = " OR ".join(f"{b} > {a}" for a, b in zip(FLAGS, FLAGS[1:]))
ORACLES["check_monotonic"] = with_sessions(union(
    rule("funnel monotonic", "fct", _monotonic),
    rule("new users in their first session", "fct", "is_new_user AND session_number_bucket <> '1'"),
))
ORACLES["check_conversion_bounds"] = with_sessions(f"""
SELECT event_date, CAST(p AS BIGINT) AS purchasers, CAST(s AS BIGINT) AS sessions, {r(div('p', 's'))} AS conversion,
 p * 1.0 / s > 1.0 OR p * 1.0 / s < 0.0005 OR p * 1.0 / s > 0.20 AS out_of_bounds
FROM (SELECT event_date, sum(purchasing_sessions) AS p, sum(sessions) AS s FROM daily GROUP BY 1) WHERE s > 0""", DAILY)
_reconcile = f"""SELECT rule, {r('mart')} AS mart_amount, {r('raw')} AS raw_amount, {r('abs(mart - raw) / raw')} AS relative_drift,
 CASE WHEN abs(mart - raw) / raw > 0.01 THEN 'fail' ELSE 'pass' END AS status FROM"""
_raw = f"(SELECT {money('rv')} FROM (SELECT transaction_id, max(purchase_revenue_in_usd) AS rv FROM stg WHERE event_name = 'purchase' AND transaction_id IS NOT NULL GROUP BY 1))"
ORACLES["check_revenue_reconcile"] = with_sessions(f"""
{_reconcile} (SELECT 'orders.gross_revenue' AS rule, (SELECT {money('gross_revenue')} FROM ord) AS mart, {_raw} AS raw
 UNION ALL SELECT 'sessions.session_revenue', (SELECT {money('session_revenue')} FROM fct), {_raw})""", ORDERS)
ORACLES["freshness"] = """
SELECT newest AS newest_date, date_diff('hour', CAST(newest AS TIMESTAMP), TIMESTAMP '2024-02-01 06:00:00') AS age_hours,
 CASE WHEN date_diff('hour', CAST(newest AS TIMESTAMP), TIMESTAMP '2024-02-01 06:00:00') > 48 THEN 'error'
  WHEN date_diff('hour', CAST(newest AS TIMESTAMP), TIMESTAMP '2024-02-01 06:00:00') > 36 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT CAST(max(ts) AS DATE) AS newest FROM events)"""
ORACLES["recency"] = with_sessions(f"""
SELECT rule, checked, violations, {STATUS} FROM (
 SELECT 'newest day is recent' AS rule, count(*) AS checked, CAST(date_diff('day', max(event_date), DATE '2024-02-01') > 2 AS BIGINT) AS violations FROM daily
 UNION ALL SELECT 'yesterday has rows', count(*), CAST(count(CASE WHEN event_date = DATE '2024-01-31' THEN 1 END) < 1 AS BIGINT) FROM daily)""", DAILY)

_old = "day(event_date) <= 10"
ORACLES["event_shards"] = sql(STG, select=f"""
SELECT event_date, count(*) AS events, count(device_category) AS devices, count(CASE WHEN NOT {_old} THEN browser END) AS browsers, count(country) AS countries,
 count(CASE WHEN NOT {_old} THEN region END) AS regions, CAST(sum(total_item_quantity) AS BIGINT) AS quantity, CAST(sum(CASE WHEN NOT {_old} THEN unique_items END) AS BIGINT) AS unique_items,
 {r(money('purchase_revenue_in_usd'))} AS revenue, CAST(sum(engagement_time_msec) AS BIGINT) AS msec
FROM stg WHERE event_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY 1""")
# the pairs of the mapping that the seed lists, with its channel
_SEEDED = """(VALUES ('(direct)', '(none)', 'Direct'), ('google', 'organic', 'Organic Search'), ('google', 'cpc', 'Paid Search'), ('dv360', 'display', 'Display'),
 ('facebook', 'cpc', 'Paid Social'), ('instagram', 'social', 'Organic Social'), ('newsletter', 'email', 'Email'), ('partner', 'affiliate', 'Affiliates'),
 ('some-blog', 'referral', 'Referral'), ('other', 'unknown', 'Other'), ('bing', 'organic', 'Organic Search'), ('youtube', 'social', 'Organic Social')) seed(s, m, seed_channel)"""
ORACLES["channel_seed"] = sql(STG, select=f"""
SELECT *, seed_channel IS NOT DISTINCT FROM channel_group AS agrees FROM (
 SELECT event_source, event_medium, gclid, events, {channel('event_source', 'event_medium', 'gclid')} AS channel_group, seed_channel
 FROM (SELECT event_source, event_medium, CASE WHEN gclid IS NOT NULL THEN 'id' END AS gclid, count(*) AS events FROM stg GROUP BY 1, 2, 3)
 LEFT JOIN {_SEEDED} ON s = event_source AND m = event_medium)""")
