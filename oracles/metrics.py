"""Oracle SQL of the metric queries."""

from oracles.common import COHORTS, ITEMS, ORACLES, ORDERS, WEEK, div, money, r, with_sessions

MONTH = "CAST(date_trunc('month', event_date) AS DATE)"
QUARTER = "CAST(date_trunc('quarter', event_date) AS DATE)"
USERS = "count(DISTINCT user_pseudo_id)"
SESSIONS = "count(DISTINCT session_key)"


def users(condition: str) -> str:
    return f"count(DISTINCT CASE WHEN {condition} THEN user_pseudo_id END)"


def step(name: str) -> str:
    return f"count(*) FILTER (reached_{name})"


STEPS = f"""{step('view_item')} AS view_item_sessions, {step('add_to_cart')} AS add_to_cart_sessions,
 {step('begin_checkout')} AS begin_checkout_sessions, {step('add_shipping_info')} AS add_shipping_info_sessions,
 {step('add_payment_info')} AS add_payment_info_sessions, {step('purchase')} AS purchasing_sessions"""
ORACLES["metric_traffic"] = with_sessions(f"""
SELECT {WEEK} AS week, channel_group, {SESSIONS} AS sessions, {USERS} AS users, {users('is_new_user')} AS new_users,
 {users('NOT is_new_user')} AS returning_users FROM fct GROUP BY 1, 2""")
ORACLES["metric_funnel"] = with_sessions(f"""
SELECT device_category, operating_system, browser, {STEPS}, {r(div(step('add_to_cart'), step('view_item')))} AS view_to_cart_rate,
 {r(div(step('begin_checkout'), step('add_to_cart')))} AS cart_to_checkout_rate,
 {r(div(step('purchase'), step('begin_checkout')))} AS checkout_to_purchase_rate FROM fct GROUP BY 1, 2, 3""")
ORACLES["metric_conversion"] = with_sessions(f"""
SELECT event_date AS day, is_new_user, {r(div(step('purchase'), SESSIONS))} AS session_conversion_rate,
 {r(div(users('reached_purchase'), USERS))} AS user_conversion_rate, {users('reached_purchase')} AS purchasing_users,
 {step('purchase')} AS purchasing_sessions FROM fct GROUP BY 1, 2""")
ORACLES["metric_stored"] = ORACLES["metric_conversion"]
ORACLES["metric_channel_conversion"] = with_sessions(f"""
SELECT channel_group, source, medium, {r(div(step('purchase'), SESSIONS))} AS channel_conversion_rate, {SESSIONS} AS sessions
FROM fct GROUP BY 1, 2, 3""")
ORACLES["metric_session_revenue"] = with_sessions(f"""
SELECT {MONTH} AS month, campaign, {r(money('session_revenue'))} AS revenue, {r(div(money('session_revenue'), USERS))} AS revenue_per_user,
 {r(div(money('session_revenue'), SESSIONS))} AS revenue_per_session FROM fct GROUP BY 1, 2""")
ORACLES["metric_session_number"] = with_sessions(f"""
SELECT {QUARTER} AS quarter, session_number_bucket, region, {SESSIONS} AS sessions, {r(money('session_revenue'))} AS revenue, {USERS} AS users
FROM fct GROUP BY 1, 2, 3""")
ORACLES["metric_engagement"] = with_sessions(f"""
SELECT landing_page, {WEEK} AS week, count(*) FILTER (engaged_session) AS engaged_sessions,
 {r(div('count(*) FILTER (engaged_session)', SESSIONS))} AS engagement_rate FROM fs GROUP BY 1, 2""")
ORACLES["metric_revenue"] = with_sessions(f"""
SELECT {WEEK} AS week, channel_group, count(DISTINCT order_key) AS orders, {r(money('gross_revenue'))} AS gross_revenue,
 {r(money('net_revenue'))} AS net_revenue, {r(div(money('gross_revenue'), 'count(DISTINCT order_key)'))} AS aov,
 {r(money('gross_revenue'))} AS channel_revenue FROM ord GROUP BY 1, 2""", ORDERS)
_retained = ", ".join(
    f"CAST(sum(retained_users_d{d}) AS BIGINT) AS retained_users_d{d}, {r(div(f'sum(retained_users_d{d})', 'sum(cohort_size)'))} AS day_{d}_retention"
    for d in (1, 7, 30)
)
ORACLES["metric_retention"] = with_sessions(f"""
SELECT cohort_week AS week, device_category, CAST(sum(cohort_size) AS BIGINT) AS cohort_size, {_retained} FROM coh GROUP BY 1, 2""", COHORTS)
ORACLES["metric_product"] = with_sessions(f"""
SELECT week, item_category, {r('product_revenue')} AS product_revenue, {r(div('item_purchases', 'item_views'))} AS product_conversion_rate,
 {r(div('orders_with_item', 'n'))} AS product_attach_rate, item_views, item_purchases, orders_with_item FROM (
  SELECT {WEEK} AS week, item_category, {money('item_revenue_in_usd')} AS product_revenue, CAST(sum(item_views) AS BIGINT) AS item_views,
   CAST(sum(item_purchases) AS BIGINT) AS item_purchases, count(DISTINCT order_key) AS orders_with_item FROM il GROUP BY 1, 2)
 LEFT JOIN (SELECT {WEEK} AS week, count(DISTINCT order_key) AS n FROM ord GROUP BY 1) USING (week)""", ORDERS, ITEMS)
ORACLES["metric_product_view"] = with_sessions(f"""
SELECT channel_group, item_brand, {r(div('item_view_sessions', 'n'))} AS product_view_rate, item_view_sessions FROM (
  SELECT channel_group, item_brand, count(DISTINCT session_key) AS item_view_sessions FROM vl GROUP BY 1, 2)
 LEFT JOIN (SELECT channel_group, count(*) FILTER (reached_view_item) AS n FROM fct GROUP BY 1) USING (channel_group)""", ORDERS, ITEMS)
ORACLES["attach_rate"] = with_sessions(f"""
SELECT item_name, {r(div('count(DISTINCT order_key)', '(SELECT count(DISTINCT order_key) FROM ord)'))} AS product_attach_rate,
 count(DISTINCT order_key) AS orders_with_item FROM il GROUP BY 1""", ORDERS, ITEMS)
PAID = "count(*) FILTER (channel_group IN ('Paid Search', 'Paid Social', 'Display'))"
NEWP = users("is_new_user AND reached_purchase")
ORACLES["metric_acquisition"] = with_sessions(f"""
SELECT {WEEK} AS week, region, {PAID} AS paid_sessions, {NEWP} AS new_purchasers FROM fct GROUP BY 1, 2""")
ORACLES["cac_proxy"] = with_sessions(f"""
SELECT {WEEK} AS week, device_category, {r(div(PAID, NEWP))} AS cac_proxy, {PAID} AS paid_sessions, {NEWP} AS new_purchasers FROM fct GROUP BY 1, 2""")


def buyers(n: int) -> str:
    return f"count(DISTINCT CASE WHEN user_order_count >= {n} THEN buyer_user_id END)"


ORACLES["repeat_purchase_rate"] = with_sessions(f"""
SELECT device_category, country, {r(div(buyers(2), buyers(1)))} AS repeat_purchase_rate, {buyers(1)} AS purchasers, {buyers(2)} AS repeat_purchasers,
 count(DISTINCT order_key) AS orders FROM bord GROUP BY 1, 2""", ORDERS)
ORACLES["traffic_share"] = with_sessions(f"""
SELECT channel_group, {r(div(SESSIONS, f'sum({SESSIONS}) OVER ()'))} AS traffic_share, {SESSIONS} AS sessions FROM fct GROUP BY 1""")
ORACLES["metric_filtered"] = with_sessions(f"""
SELECT {WEEK} AS week, device_category, {SESSIONS} AS sessions, {r(div(step('purchase'), SESSIONS))} AS session_conversion_rate,
 {r(money('session_revenue'))} AS revenue, {USERS} AS users FROM fct
WHERE event_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-27' AND channel_group NOT IN ('Direct', 'Other') AND device_category IN ('mobile', 'desktop')
 AND country <> 'NATION_3' AND is_new_user = false AND {WEEK} >= DATE '2024-01-01' AND {WEEK} < DATE '2024-01-29' AND {MONTH} <= DATE '2024-01-01'
 AND event_date > DATE '2024-01-02' GROUP BY 1, 2""")
ORACLES["metric_total"] = with_sessions(f"""
SELECT {SESSIONS} AS sessions, {USERS} AS users, {step('purchase')} AS purchasing_sessions, {r(money('session_revenue'))} AS revenue,
 {r(div(step('purchase'), SESSIONS))} AS session_conversion_rate, 1.0::DOUBLE AS traffic_share FROM fct""")
ORACLES["metric_total_orders"] = with_sessions(f"""
SELECT count(DISTINCT order_key) AS orders, {r(money('net_revenue'))} AS net_revenue, {r(div(money('gross_revenue'), 'count(DISTINCT order_key)'))} AS aov,
 {r(div(buyers(2), buyers(1)))} AS repeat_purchase_rate, {buyers(1)} AS purchasers FROM bord""", ORDERS)
ORACLES["metric_total_products"] = with_sessions(f"""
SELECT {r(div('count(DISTINCT order_key)', '(SELECT count(DISTINCT order_key) FROM ord)'))} AS product_attach_rate,
 CAST(sum(item_views) AS BIGINT) AS item_views, {r(money('item_revenue_in_usd'))} AS product_revenue FROM il WHERE item_category IN ('ECONOMY', 'SMALL')""", ORDERS, ITEMS)

# filters on dimensions of other tables: sessions, lines of orders and views, first sessions of users
_SOLD = f"""CAST(sum(item_purchases) AS BIGINT) AS item_purchases, CAST(sum(item_views) AS BIGINT) AS item_views, {r(money('item_revenue_in_usd'))} AS product_revenue"""
ORACLES["orders_by_browser"] = with_sessions(f"""
SELECT channel_group, count(DISTINCT order_key) AS orders, {r(money('gross_revenue'))} AS gross_revenue,
 {r(div(money('gross_revenue'), 'count(DISTINCT order_key)'))} AS aov, {r(div(buyers(2), buyers(1)))} AS repeat_purchase_rate
FROM bord WHERE session_key IN (SELECT session_key FROM fs WHERE browser IN ('Chrome', 'Edge') AND region <> 'ASIA') GROUP BY 1""", ORDERS)
ORACLES["orders_with_brand"] = with_sessions(f"""
SELECT {WEEK} AS week, count(DISTINCT order_key) AS orders, {r(money('net_revenue'))} AS net_revenue FROM ord
WHERE order_key IN (SELECT order_key FROM oi WHERE item_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND item_category <> 'SMALL') GROUP BY 1""", ORDERS, ITEMS)
ORACLES["product_revenue_by_source"] = with_sessions(f"""
SELECT item_category, {_SOLD} FROM (
 SELECT session_key, event_date, item_category, 1 AS item_purchases, 0 AS item_views, item_revenue_in_usd FROM oi
 UNION ALL SELECT session_key, event_date, item_category, 0, views, NULL FROM vl)
WHERE event_date >= DATE '2024-01-08' AND session_key IN (SELECT session_key FROM fs WHERE source NOT IN ('google', '(direct)')) GROUP BY 1""", ORDERS, ITEMS)
ORACLES["cohort_size_by_landing_page"] = with_sessions(f"""
SELECT CAST(date_trunc('week', ud.first_date) AS DATE) AS week, ud.device_category, count(*) AS cohort_size,
 count(*) FILTER (d1) AS retained_users_d1, count(*) FILTER (d7) AS retained_users_d7, {r(div('count(*) FILTER (d7)', 'count(*)'))} AS day_7_retention
FROM ud JOIN fd USING (user_pseudo_id) JOIN fs ON fs.session_key = fd.first_key
WHERE fs.landing_page < '/p/5' AND ud.country <> 'NATION_3' GROUP BY 1, 2""", COHORTS)
ORACLES["sessions_by_item"] = with_sessions(f"""
SELECT channel_group, {SESSIONS} AS sessions, {USERS} AS users, {r(div(step('purchase'), SESSIONS))} AS session_conversion_rate FROM fct
WHERE browser = 'Chrome' AND session_key IN (SELECT session_key FROM oi WHERE item_category = 'ECONOMY' UNION SELECT session_key FROM vl WHERE item_category = 'ECONOMY')
GROUP BY 1""", ORDERS, ITEMS)
