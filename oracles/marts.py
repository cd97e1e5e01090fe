"""Oracle SQL of the mart queries."""

from oracles.common import (
    CELLS, COHORTS, COUNT_NAMES, FLAGS, ITEMS, ORACLES, ORDERS, SESS, STG, WEEKLY, channel, counts, dec, div, money, r, sql,
    with_sessions,
)

STG_COLUMNS = """session_key, event_date, event_name, event_timestamp, user_pseudo_id, ga_session_id, ga_session_number,
 page_location, session_engaged, engagement_time_msec, event_source, event_medium, event_campaign, gclid,
 first_touch_source, first_touch_medium, first_touch_campaign, device_category, operating_system, browser, country, region"""
_stg = "transaction_id, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("purchase_revenue_in_usd", "refund_value_in_usd", "shipping_value_in_usd", "tax_value_in_usd")
) + ", total_item_quantity"
# r() of NULL: abs(NULL) < x is NULL, so ELSE round(NULL) = NULL
ORACLES["stg_events"] = sql(STG, select=f"SELECT {STG_COLUMNS}, {_stg} FROM stg")

_PARAMS = (
    ("ga_session_id", None, "ga_session_id"), ("ga_session_number", None, "ga_session_number"),
    ("page_location", "page_location", None), ("session_engaged", "session_engaged", None),
    ("engagement_time_msec", None, "engagement_time_msec"), ("source", "event_source", None),
    ("medium", "event_medium", None), ("campaign", "event_campaign", None), ("gclid", "gclid", None),
)
ORACLES["stg_event_params"] = sql(STG, select="\nUNION ALL\n".join(
    f"""SELECT event_date, event_name, event_timestamp, user_pseudo_id, '{key}' AS param_key,
 {s or 'CAST(NULL AS VARCHAR)'} AS string_value, {i or 'CAST(NULL AS BIGINT)'} AS int_value, CAST({s or i} AS VARCHAR) AS value_string
 FROM stg WHERE {s or i} IS NOT NULL""" for key, s, i in _PARAMS
))
ORACLES["event_param_lookup"] = sql(STG, select="""
SELECT event_name, count(*) AS events, count(ga_session_id) AS with_session, count(page_location) AS with_page,
 max(page_location) AS last_page, count(event_campaign) AS with_campaign, CAST(sum(engagement_time_msec) AS BIGINT) AS msec,
 CAST(0 AS BIGINT) AS wrong_slot, CAST(0 AS BIGINT) AS absent FROM stg GROUP BY 1""")
ORACLES["session_keys"] = sql(STG, select="SELECT user_pseudo_id, ga_session_id, session_key, count(*) AS events FROM stg GROUP BY 1, 2, 3")
ORACLES["channel_group_counts"] = sql(STG, select=f"""
SELECT event_source, event_medium, {channel('event_source', 'event_medium', 'gclid')} AS channel, count(*) AS events FROM stg GROUP BY 1, 2, 3""")
ORACLES["sessionized"] = with_sessions("SELECT * EXCLUDE (event_count, engagement_time_msec) FROM sess")
ORACLES["landing_page"] = with_sessions("SELECT landing_page, count(*) AS sessions FROM sess GROUP BY 1")
ORACLES["funnel_steps"] = with_sessions("SELECT * FROM steps")
ORACLES["session_revenue_dedup"] = with_sessions("SELECT session_key, transaction_id, session_revenue FROM steps WHERE session_revenue > 0")
ORACLES["fct_funnel"] = with_sessions("SELECT * FROM fct")
ORACLES["fct_funnel_join"] = ORACLES["fct_funnel"]
ORACLES["fct_sessions"] = with_sessions("SELECT * FROM fs")

_KEY = "md5(" + " || '-' || ".join(
    f"coalesce(CAST({c} AS VARCHAR), '_dbt_utils_surrogate_key_null_')"
    for c in ("event_date", "channel_group", "device_category", "country", "is_new_user")
) + ")"
DAILY = f"""
daily AS (SELECT {_KEY} AS daily_funnel_key, * FROM (
 SELECT event_date, channel_group, device_category, country, is_new_user, {counts()} FROM fct GROUP BY 1, 2, 3, 4, 5))"""
ORACLES["fct_daily_funnel"] = with_sessions("SELECT * FROM daily", DAILY)
ORACLES["fct_daily_funnel_distinct"] = ORACLES["fct_daily_funnel"]
ORACLES["incremental_overwrite"] = ORACLES["fct_daily_funnel"]
ORACLES["streaming_daily_funnel"] = ORACLES["fct_daily_funnel"]
# sessions of two days: the id is the number of the day halved
_TWO_DAYS = STG.replace("CAST(d AS BIGINT) END AS ga_session_id", "CAST(d // 2 AS BIGINT) END AS ga_session_id").replace("'-' || d)", "'-' || d // 2)")
ORACLES["late_moved_sessions"] = sql(_TWO_DAYS, SESS, DAILY, select="SELECT * FROM daily")
ORACLES["late_event_counts"] = sql(STG, select="""
SELECT event_date, count(*) AS late_events FROM stg, (SELECT min(event_date) AS first, max(event_date) AS last FROM stg)
WHERE event_date > last - 2 OR (event_date = first AND uid % 2 = 0) GROUP BY event_date""")
ORACLES["streaming_moved_sessions"] = ORACLES["late_moved_sessions"]
ORACLES["fct_orders"] = with_sessions("SELECT * FROM ord", ORDERS)
ORACLES["orders_in_window"] = with_sessions(f"""
SELECT event_date, channel_group, count(*) AS orders, {money('gross_revenue')} AS gross_revenue, {money('net_revenue')} AS net_revenue,
 {money('tax_value_in_usd')} AS tax FROM ord WHERE event_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY 1, 2""", ORDERS)

CHANNELS = """(VALUES ('Direct',false,false,1),('Organic Search',false,true,2),('Paid Search',true,false,3),('Display',true,false,4),
 ('Paid Social',true,false,5),('Organic Social',false,true,6),('Email',false,true,7),('Affiliates',true,false,8),
 ('Referral',false,true,9),('Other',false,false,10)) ch(channel_group, is_paid, is_organic, channel_group_order)"""
ORACLES["dim_channels"] = with_sessions(f"""
SELECT channel_group, md5(channel_group) AS channel_key, is_paid, is_organic, CAST(channel_group_order AS BIGINT) AS channel_group_order, sessions
FROM {CHANNELS} LEFT JOIN (SELECT channel_group, count(*) AS sessions FROM fct GROUP BY 1) USING (channel_group)""")
ORACLES["dim_date"] = with_sessions("""
SELECT md5(CAST(dd AS VARCHAR)) AS date_key, dd AS event_date, year(dd) AS year, quarter(dd) AS quarter, month(dd) AS month,
 weekofyear(dd) AS week, dayofweek(dd) + 1 AS day_of_week, dayname(dd) AS day_name, dayofweek(dd) IN (0, 6) AS is_weekend
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS dd FROM (SELECT min(event_date) AS lo, max(event_date) AS hi FROM fct))""")
ORACLES["weekly_funnel"] = with_sessions("SELECT * EXCLUDE (transactions) FROM weekly", WEEKLY)
ORACLES["weekly_from_daily"] = ORACLES["weekly_funnel"]
ORACLES["funnel_by_dim"] = with_sessions("\nUNION ALL\n".join(
    f"SELECT event_date, '{d}' AS dimension, {d} AS dimension_value, {counts()} FROM fct GROUP BY event_date, {d}"
    for d in ("channel_group", "device_category", "country", "operating_system")
))
BASE_SEGMENTS = """
bseg AS (SELECT channel_group || ' / ' || device_category AS segment, CAST(sum(purchasing_sessions) AS BIGINT) AS num, CAST(sum(sessions) AS BIGINT) AS den
 FROM weekly GROUP BY 1 HAVING sum(sessions) > 0)"""
ORACLES["base_segments"] = with_sessions("SELECT * FROM bseg", WEEKLY, BASE_SEGMENTS)
ORACLES["fct_order_items"] = with_sessions("SELECT * FROM oi", ORDERS, ITEMS)
ORACLES["item_view_lines"] = with_sessions("SELECT * FROM vl", ORDERS, ITEMS)
ORACLES["buyer_order_counts"] = with_sessions("SELECT order_key, buyer_user_id, user_order_count FROM bord", ORDERS)
ORACLES["dim_users"] = with_sessions(f"""
, x AS (SELECT user_pseudo_id AS user_key, min(session_start_ts) AS first_touch_ts, arg_min(session_key, (session_start_ts, session_key)) AS fk,
 count(DISTINCT session_key) AS total_sessions, {money('session_revenue')} AS total_revenue, bool_or(is_new_user) AS is_new_user FROM fs GROUP BY 1)
SELECT user_key, first_touch_ts, f.source AS first_touch_source, f.medium AS first_touch_medium, md5(f.channel_group) AS first_channel_key,
 total_sessions, total_revenue, total_revenue > 0 AS is_purchaser, x.is_new_user FROM x JOIN fs f ON f.session_key = x.fk""")
ORACLES["dim_items"] = with_sessions("""
SELECT item_id AS item_key, arg_max(item_name, event_timestamp) AS item_name, arg_max(item_brand, event_timestamp) AS item_brand,
 arg_max(item_category, event_timestamp) AS item_category, arg_max(price_in_usd, event_timestamp) AS current_price_in_usd FROM seen GROUP BY 1""", ORDERS, ITEMS)
ORACLES["items_scd2"] = f"""
WITH obs AS (SELECT l_partkey AS item_key, CAST(l_shipdate AS DATE) AS day, l_shipdate AS ts, (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) / 100.0::DOUBLE AS price_in_usd,
 p_type AS item_category, p_name AS item_name FROM lineitem JOIN part ON l_partkey = p_partkey),
dayly AS (SELECT item_key, day, price_in_usd, item_category, item_name FROM obs
 QUALIFY row_number() OVER (PARTITION BY item_key, day ORDER BY ts DESC, price_in_usd DESC) = 1),
chg AS (SELECT *, lag(price_in_usd) OVER w AS pp, row_number() OVER w AS rn FROM dayly WINDOW w AS (PARTITION BY item_key ORDER BY day)),
v AS (SELECT * FROM chg WHERE rn = 1 OR pp IS DISTINCT FROM price_in_usd)
SELECT item_key, price_in_usd, item_category, item_name, day AS valid_from, lead(day) OVER w AS valid_to, row_number() OVER w AS version
FROM v WINDOW w AS (PARTITION BY item_key ORDER BY day)"""
ORACLES["fct_cohorts"] = with_sessions("SELECT * FROM coh", COHORTS)
_act = """act AS (SELECT DISTINCT f.user_pseudo_id, CAST(date_trunc('week', fd.first_date) AS DATE) AS cohort_week, f.event_date FROM fs f JOIN fd USING (user_pseudo_id))"""
ORACLES["retention_curve"] = with_sessions(f"""
SELECT a.cohort_week, date_diff('day', a.cohort_week, event_date) AS age_days, count(*) AS active_users, any_value(n) AS cohort_size,
 {r(div('count(*)', 'any_value(n)'))} AS retention_rate
FROM act a JOIN (SELECT cohort_week, count(DISTINCT user_pseudo_id) AS n FROM act GROUP BY 1) s ON a.cohort_week = s.cohort_week GROUP BY 1, 2""", COHORTS, _act)
def _periods(start: str, newest: str) -> str:
    """Share of a cohort per age; NULL for a period that starts after the newest day."""
    share = lambda p: r(div(f"count(DISTINCT CASE WHEN age = {p} THEN user_pseudo_id END)", "count(DISTINCT user_pseudo_id)"))
    return ", ".join(f"CASE WHEN {start.format(p=p)} <= {newest} THEN {share(p)} END AS period_{p}" for p in range(5))


ORACLES["cohort_retention"] = with_sessions(f"""
SELECT cohort_week AS cohort, count(DISTINCT user_pseudo_id) AS cohort_size,
 {_periods("cohort_week + {p} * 7", "(SELECT max(event_date) FROM fs)")}
FROM (SELECT *, date_diff('week', cohort_week, event_date) AS age FROM act) GROUP BY 1""", COHORTS, _act)
for _same, _name in (
    ("bucketed_funnel", "fct_funnel"), ("bucketed_sessions", "fct_sessions"), ("bucketed_cohorts", "fct_cohorts"), ("bitmap_cohorts", "fct_cohorts"),
    ("bitmap_retention_curve", "retention_curve"), ("bitmap_cohort_retention", "cohort_retention"),
):
    ORACLES[_same] = ORACLES[_name]
ORACLES["cohort_retention_orders"] = f"""
WITH o AS (SELECT o_custkey AS user_pseudo_id, CAST(o_orderdate AS DATE) AS event_date FROM orders),
f AS (SELECT user_pseudo_id, CAST(date_trunc('month', min(event_date)) AS DATE) AS cohort FROM o GROUP BY 1),
a AS (SELECT DISTINCT user_pseudo_id, cohort, date_diff('month', cohort, event_date) AS age FROM o JOIN f USING (user_pseudo_id))
SELECT cohort, count(DISTINCT user_pseudo_id) AS cohort_size, {_periods("CAST(cohort + to_months({p}) AS DATE)", "(SELECT max(event_date) FROM o)")}
FROM a GROUP BY 1"""
ORACLES["rfm_scores"] = f"""
WITH u AS (SELECT o_custkey AS user_id, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-01-01') AS recency, count(*) AS frequency,
 {money('o_totalprice')} AS monetary FROM orders GROUP BY 1),
s AS (SELECT *, CAST(floor(5.0 * (rank() OVER (ORDER BY -recency) - 1) / count(*) OVER ()) + 1 AS BIGINT) AS recency_score,
 CAST(floor(5.0 * (rank() OVER (ORDER BY frequency) - 1) / count(*) OVER ()) + 1 AS BIGINT) AS frequency_score,
 CAST(floor(5.0 * (rank() OVER (ORDER BY monetary) - 1) / count(*) OVER ()) + 1 AS BIGINT) AS monetary_score FROM u)
SELECT user_id, recency, frequency, monetary, recency_score, frequency_score, monetary_score,
 CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'champion' WHEN recency_score >= 4 AND frequency_score <= 2 THEN 'new'
  WHEN recency_score <= 2 AND frequency_score >= 4 THEN 'at risk' WHEN recency_score <= 2 AND frequency_score <= 2 THEN 'lapsed' ELSE 'regular' END AS label FROM s"""


def last_channel(days: int) -> str:
    """The latest channel other than Direct up to each session, by an independent correlated search."""
    return f"""lnd AS (
 SELECT a.*, coalesce((SELECT arg_max(b.channel_group, (b.session_start_ts, b.session_key)) FROM fs b
  WHERE b.user_pseudo_id = a.user_pseudo_id AND b.channel_group <> 'Direct'
   AND (b.session_start_ts, b.session_key) <= (a.session_start_ts, a.session_key)
   AND b.event_date >= a.event_date - {days}), 'Direct') AS last_non_direct_channel FROM fs a)"""


ORACLES["last_non_direct"] = with_sessions(
    "SELECT session_key, event_date, channel_group, last_non_direct_channel FROM lnd", last_channel(7))
ORACLES["attribution_models"] = with_sessions(f"""
, ft AS (SELECT user_pseudo_id, arg_min(channel_group, (session_start_ts, session_key)) AS first_channel FROM fs GROUP BY 1),
conv AS (SELECT lnd.*, ft.first_channel FROM lnd JOIN ft USING (user_pseudo_id) WHERE reached_purchase),
long AS (SELECT 'first_touch' AS model, first_channel AS credited_channel, session_revenue FROM conv
 UNION ALL SELECT 'last_touch', channel_group, session_revenue FROM conv
 UNION ALL SELECT 'last_non_direct', last_non_direct_channel, session_revenue FROM conv)
SELECT model, credited_channel, count(*) AS conversions, {money('session_revenue')} AS revenue FROM long GROUP BY 1, 2""", last_channel(90))
