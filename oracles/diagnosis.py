"""Oracle SQL of the statistics, diagnosis, verdict and benchmark queries."""

from __future__ import annotations

import statistics

from funnelspark.functions.numeric import (
    ERFC_MIDDLE, ERFC_TAIL, ERF_SMALL, PPF_CENTER, PPF_MIDDLE, PPF_TAIL,
)
from funnelspark.operators.benchmark import DEFAULT_SCENARIOS
from funnelspark.plans.diagnosis_queries import LABELED_SCENARIOS
from oracles.common import CELLS, COUNT_NAMES, ORACLES, ORDERS, WEEK, WEEKLY, counts, div, money, r, sql, with_sessions
from oracles.marts import BASE_SEGMENTS

Z95 = repr(statistics.NormalDist().inv_cdf(0.975))
Z80 = repr(statistics.NormalDist().inv_cdf(0.80))


def _poly(coefficients, x: str) -> str:
    """Sum of powers (the engine nests the products instead)."""
    top = len(coefficients) - 1
    return "(" + " + ".join(f"{c!r}::DOUBLE * pow({x}, {top - i})" for i, c in enumerate(coefficients)) + ")"


def _ratio(pair, x: str) -> str:
    return f"({_poly(pair[0], x)} / {_poly(pair[1], x)})"


def p_value(z: str) -> str:
    """Two-sided p from |z| / sqrt(2)."""
    y = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    return f"""(CASE WHEN {y} <= 0.46875 THEN 1 - {y} * {_ratio(ERF_SMALL, f'({y} * {y})')}
 WHEN {y} <= 4 THEN exp(-{y} * {y}) * {_ratio(ERFC_MIDDLE, y)}
 ELSE exp(-{y} * {y}) / {y} * (1 / sqrt(pi()) - 1 / ({y} * {y}) * {_ratio(ERFC_TAIL, f'(1 / ({y} * {y}))')}) END)"""


def z_test(na: str, da: str, nb: str, db: str) -> str:
    na, da, nb, db = (f"CAST({x} AS DOUBLE)" for x in (na, da, nb, db))
    pooled = f"(({na} + {nb}) / ({da} + {db}))"
    variance = f"(greatest({pooled} * (1 - {pooled}), 0) * (1 / {da} + 1 / {db}))"
    return f"(CASE WHEN {da} > 0 AND {db} > 0 THEN coalesce(({nb} / {db} - {na} / {da}) / nullif(sqrt({variance}), 0), 0) END)"


SIGNIFICANT = f"abs(z) > {Z95}"

PAIRS = """
wk AS (SELECT week, sum(sessions) AS s, sum(purchasing_sessions) AS p, coalesce(CAST(sum(purchasing_sessions) AS DOUBLE) / nullif(sum(sessions), 0), 0) AS conv FROM weekly GROUP BY 1),
pairs AS (SELECT lag(week) OVER (ORDER BY week) AS w0, week AS w1, conv - lag(conv) OVER (ORDER BY week) AS delta FROM wk QUALIFY lag(week) OVER (ORDER BY week) IS NOT NULL)"""


def segments(label: str = "channel_group || ' / ' || device_category", num: str = "purchasing_sessions", den: str = "sessions", pairs: str = "pairs") -> str:
    def side(week: str, c: str) -> str:
        return f"CAST(sum(CASE WHEN week = {week} THEN {c} ELSE 0 END) AS DOUBLE)"

    return f"""
segs AS (SELECT w0, w1, {label} AS segment, {side('w0', num)} AS num_t0, {side('w0', den)} AS den_t0, {side('w1', num)} AS num_t1, {side('w1', den)} AS den_t1
 FROM {pairs} JOIN weekly ON week IN (w0, w1) GROUP BY 1, 2, 3)"""


def effects(by: str = "w0, w1", source: str = "segs") -> str:
    return f"""
shr AS (SELECT *, den_t0 / nullif(sum(den_t0) OVER (PARTITION BY {by}), 0) AS w_t0, den_t1 / nullif(sum(den_t1) OVER (PARTITION BY {by}), 0) AS w_t1,
 coalesce(num_t0 / nullif(den_t0, 0), 0) AS r_t0, coalesce(num_t1 / nullif(den_t1, 0), 0) AS r_t1 FROM {source}),
eff AS (SELECT *, (w_t1 - w_t0) * r_t0 AS mix, w_t0 * (r_t1 - r_t0) AS rate, (w_t1 - w_t0) * (r_t1 - r_t0) AS interaction,
 (w_t1 - w_t0) * r_t0 + w_t0 * (r_t1 - r_t0) + (w_t1 - w_t0) * (r_t1 - r_t0) AS total FROM shr),
sm0 AS (SELECT {by}, sum(w_t0 * r_t0) AS r_t0, sum(w_t1 * r_t1) AS r_t1, sum(mix) AS mix, sum(rate) AS rate, sum(interaction) AS interaction FROM eff GROUP BY {by}),
sm AS (SELECT *, r_t1 - r_t0 AS delta, CASE WHEN abs(mix) >= abs(rate) AND abs(mix) >= abs(interaction) THEN 'mix'
  WHEN abs(rate) >= abs(interaction) THEN 'rate' ELSE 'interaction' END AS dominant,
 abs(mix + rate + interaction - (r_t1 - r_t0)) <= 1e-9 AS additive FROM sm0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY abs(total) DESC, segment) AS driver_rank FROM eff)"""


_EFFECTS = ", ".join(f"{r(c)} AS {c}" for c in ("w_t0", "w_t1", "r_t0", "r_t1"))
_PARTS = ", ".join(f"{r(c)} AS {c}" for c in ("mix", "rate", "interaction"))
EFFECT_ROWS = f"SELECT w0, w1, segment, num_t0, den_t0, num_t1, den_t1, {_EFFECTS}, CAST(NULL AS VARCHAR) AS error, {_PARTS}, {r('total')} AS total FROM eff"
SUMMARY_ROWS = f"SELECT w0, w1, {r('r_t0')} AS r_t0, {r('r_t1')} AS r_t1, {_PARTS}, CAST(NULL AS VARCHAR) AS error, {r('delta')} AS delta, dominant, additive FROM sm"

ORACLES["decompose_week_pairs"] = with_sessions(EFFECT_ROWS, WEEKLY, PAIRS, segments(), effects())
ORACLES["decompose_day_pairs"] = with_sessions(SUMMARY_ROWS, CELLS, PAIRS, segments(), effects())
ORACLES["dominant_effect"] = with_sessions(SUMMARY_ROWS, WEEKLY, PAIRS, segments(), effects())
_country = f"""
weekly AS (SELECT {WEEK} AS week, country, {counts()} FROM fct GROUP BY 1, 2)"""
ORACLES["decompose_countries"] = with_sessions(
    EFFECT_ROWS, _country, PAIRS, segments("country", "add_to_cart_sessions", "view_item_sessions"), effects())
NAIVE = """
nv AS (SELECT {by}, arg_min(segment, (-mv, segment)) AS seg, max(mv) AS mv FROM (SELECT {by}, segment,
 abs(coalesce(num_t1 / nullif(den_t1, 0), 0) - coalesce(num_t0 / nullif(den_t0, 0), 0)) AS mv FROM segs) GROUP BY {by}),
naive AS (SELECT {by}, CASE WHEN mv >= 1e-9 THEN seg ELSE '(no segment — no rate change detected)' END AS naive_segment FROM nv)"""
ORACLES["naive_baseline"] = with_sessions("SELECT * FROM naive", WEEKLY, PAIRS, segments(), NAIVE.format(by="w0, w1"))

TOTALS = """
tot AS (SELECT w0, w1, """ + ", ".join(
    f"CAST(sum(CASE WHEN week = w{s} THEN {c} END) AS BIGINT) AS {c}_t{s}" for s in (0, 1) for c in COUNT_NAMES
) + f""",
 {money('CASE WHEN week = w1 THEN revenue END')} AS revenue_t1 FROM pairs JOIN weekly ON week IN (w0, w1) GROUP BY 1, 2),
tst AS (SELECT *, {z_test('purchasing_sessions_t0', 'sessions_t0', 'purchasing_sessions_t1', 'sessions_t1')} AS z FROM tot)"""
Z_COLUMNS = f"{r('z')} AS z, {r(p_value('z'))} AS p_value, {SIGNIFICANT} AS significant"
ORACLES["ztest_week_pairs"] = with_sessions(f"SELECT w0, w1, {Z_COLUMNS} FROM tst", WEEKLY, PAIRS, TOTALS)
ORACLES["ztest_segments"] = with_sessions(
    f"SELECT w0, w1, segment, {Z_COLUMNS} FROM (SELECT *, {z_test('num_t0', 'den_t0', 'num_t1', 'den_t1')} AS z FROM segs)",
    CELLS, PAIRS, segments("channel_group", "add_to_cart_sessions"))
ORACLES["mean_test"] = f"""
WITH s AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_a, count(*) FILTER (o_orderstatus = 'O') AS n_b,
 avg(o_totalprice) FILTER (o_orderstatus = 'F') AS mean_a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mean_b,
 var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS va, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS vb FROM orders GROUP BY 1),
t AS (SELECT *, mean_b - mean_a AS diff, sqrt(va / n_a + vb / n_b) AS se, sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS sd FROM s),
u AS (SELECT *, diff / se AS z FROM t)
SELECT o_orderpriority, n_a, n_b, {r('mean_a', 5)} AS mean_a, {r('mean_b', 5)} AS mean_b, {r('diff', 5)} AS difference, {r('diff / sd', 5)} AS effect_size,
 {r(f'diff - {Z95} * se', 5)} AS ci_low, {r(f'diff + {Z95} * se', 5)} AS ci_high, {r('z', 5)} AS z, {r(p_value('z'), 5)} AS p_value, {SIGNIFICANT} AS significant FROM u"""
_q, _r = "(p - 0.5)", "sqrt(-ln(least(p, 1 - p)))"
ORACLES["normal_quantiles"] = f"""
SELECT p_partkey, {r('p', 7)} AS p, {r(f'''CASE WHEN abs{_q} <= 0.425 THEN {_q} * {_ratio(PPF_CENTER, f'(0.180625 - {_q} * {_q})')}
 ELSE sign{_q} * CASE WHEN {_r} <= 5 THEN {_ratio(PPF_MIDDLE, f'({_r} - 1.6)')} ELSE {_ratio(PPF_TAIL, f'({_r} - 5)')} END END''', 7)} AS z
FROM (SELECT p_partkey, (p_partkey % 997 + 1) / 1000.0::DOUBLE AS p FROM part)"""

# ── series ────────────────────────────────────────────────────────────────────
ORDER_SERIES = f"""
pts AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) AS t, {money('o_totalprice')} AS value FROM orders GROUP BY 1, 2)"""
CONVERSION_SERIES = """
pts AS (SELECT device_category AS series_id, event_date AS t, count(*) FILTER (reached_purchase) / CAST(count(*) AS DOUBLE) AS value FROM fct GROUP BY 1, 2)"""
SCORED = """
rs AS (SELECT *, row_number() OVER w - 1 AS position, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS f FROM pts WINDOW w AS (PARTITION BY series_id ORDER BY t)),
sg AS (SELECT *, greatest(coalesce(stddev_pop(value - f) OVER (PARTITION BY series_id), 0), 0.01 * abs(avg(value) OVER (PARTITION BY series_id)), 1e-12) AS sigma FROM rs),
zs AS (SELECT *, CASE WHEN position >= 3 THEN (value - f) / sigma ELSE 0 END AS z FROM sg)"""


def anomaly(digits: int) -> str:
    return f"""SELECT series_id, t, {r('value', digits)} AS value, CAST(position AS BIGINT) AS position, {r('CASE WHEN position >= 3 THEN f END', digits)} AS forecast,
 {r('sigma', digits)} AS sigma, {r('z', digits)} AS z, abs(z) > 2.5 AS is_anomaly FROM zs"""


def forecast(digits: int) -> str:
    return f"""SELECT series_id, {r('fc', digits)} AS forecast, {r(f'fc - {Z95} * sigma', digits)} AS low, {r(f'fc + {Z95} * sigma', digits)} AS high, {r('sigma', digits)} AS sigma
 FROM (SELECT series_id, avg(value) FILTER (back <= 4) AS fc, max(sigma) AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS back FROM zs) GROUP BY 1)"""


ORACLES["anomaly_weekly"] = sql(ORDER_SERIES, SCORED, select=anomaly(4))
ORACLES["anomaly_daily"] = with_sessions(anomaly(8), CONVERSION_SERIES, SCORED)
ORACLES["forecast_next"] = sql(ORDER_SERIES, SCORED, select=forecast(4))
ORACLES["forecast_conversion"] = with_sessions(forecast(8), CONVERSION_SERIES, SCORED)
ORACLES["iqr_anomaly"] = sql(ORDER_SERIES, select=f"""
SELECT series_id, t, {r('value', 4)} AS value, {r('q1', 4)} AS q1, {r('q3', 4)} AS q3,
 {r('coalesce(greatest(q1 - 1.5 * (q3 - q1) - value, value - (q3 + 1.5 * (q3 - q1)), 0) / nullif(q3 - q1, 0), 0)', 4)} AS score,
 value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_anomaly,
 CASE WHEN value > q3 + 1.5 * (q3 - q1) THEN 'up' WHEN value < q1 - 1.5 * (q3 - q1) THEN 'down' ELSE 'none' END AS direction
FROM pts JOIN (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM pts GROUP BY 1) USING (series_id)""")
ORACLES["ewma_anomaly"] = "WITH RECURSIVE " + with_sessions(f"""
, num AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i FROM pts),
lv AS (SELECT series_id, i, t, value, CAST(NULL AS DOUBLE) AS level FROM num WHERE i = 1
 UNION ALL SELECT n.series_id, n.i, n.t, n.value, CASE WHEN lv.level IS NULL THEN lv.value ELSE 0.3 * lv.value + 0.7 * lv.level END
 FROM lv JOIN num n ON n.series_id = lv.series_id AND n.i = lv.i + 1),
sc AS (SELECT *, coalesce((value - level) / nullif(stddev_pop(value - level) OVER (PARTITION BY series_id), 0), 0) AS score FROM lv)
SELECT series_id, t, {r('value', 6)} AS value, {r('level', 6)} AS level, {r('score', 6)} AS score, abs(score) > 3.0 AS is_anomaly FROM sc""",
    CONVERSION_SERIES).removeprefix("WITH ")
ORACLES["seasonal_residual"] = with_sessions(f"""
, a AS (SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS level FROM pts),
b AS (SELECT *, avg(value - level) OVER (PARTITION BY series_id, dayofweek(t)) AS seasonal FROM a),
c AS (SELECT *, value - level - seasonal AS residual FROM b),
d AS (SELECT *, coalesce(residual / nullif(stddev_pop(residual) OVER (PARTITION BY series_id), 0), 0) AS score FROM c)
SELECT series_id, t, {", ".join(f"{r(c, 6)} AS {c}" for c in ("value", "level", "seasonal", "residual", "score"))}, abs(score) > 3.0 AS is_anomaly FROM d""",
    CONVERSION_SERIES)
ORACLES["weekly_conversion"] = with_sessions(f"""
SELECT week, CAST(s AS BIGINT) AS sessions, CAST(p AS BIGINT) AS purchasing_sessions, {r(div('p', 's'))} AS conversion FROM wk""", WEEKLY, PAIRS)

# ── diagnosis ─────────────────────────────────────────────────────────────────
BIGGEST = """
big AS (SELECT w0, w1 FROM pairs ORDER BY abs(delta) DESC, w1 LIMIT 1)"""
ORACLES["adjacent_pairs"] = with_sessions(f"SELECT w0, w1, {r('delta')} AS delta FROM pairs", WEEKLY, PAIRS)
ORACLES["biggest_move"] = with_sessions("SELECT w0, w1 FROM big", WEEKLY, PAIRS, BIGGEST)
ORACLES["anomalous_move"] = with_sessions("""
, flagged AS (SELECT lag(t) OVER (ORDER BY t) AS w0, t AS w1, z FROM zs QUALIFY abs(z) > 2.5),
worst AS (SELECT w0, w1 FROM flagged ORDER BY abs(z) DESC, w1 LIMIT 1)
SELECT * FROM worst UNION ALL SELECT * FROM big WHERE NOT EXISTS (SELECT 1 FROM worst)""",
    CELLS, PAIRS, BIGGEST, "\npts AS (SELECT 1 AS series_id, week AS t, conv AS value FROM wk)", SCORED)

DIAG = f"""
dg AS (SELECT s.w0, s.w1, s.r_t0 AS conv_t0, s.r_t1 AS conv_t1, s.delta, s.mix, s.rate, s.interaction, s.dominant, {p_value('t.z')} AS p_value, abs(t.z) > {Z95} AS significant,
 t.sessions_t1, coalesce(t.revenue_t1 / nullif(t.purchasing_sessions_t1, 0), 0) AS aov,
 s.rate * t.sessions_t1 * coalesce(t.revenue_t1 / nullif(t.purchasing_sessions_t1, 0), 0) AS revenue_at_risk, d.segment AS top_segment, t.*EXCLUDE (w0, w1, sessions_t1)
 FROM sm s JOIN tst t USING (w0, w1) LEFT JOIN ranked d ON d.w0 = s.w0 AND d.w1 = s.w1 AND d.driver_rank = 1)"""


def _broken(side: int) -> str:
    return " OR ".join(f"{b}_t{side} > {a}_t{side}" for a, b in zip(COUNT_NAMES, COUNT_NAMES[1:])).replace("sessions_t1 ", "sessions_t1 ")


CHECKS = f"""
ck AS (SELECT *,
 CASE WHEN abs(mix + rate + interaction - delta) <= greatest(0.005 * abs(delta), 1e-9) THEN 'PASS' ELSE 'FAIL' END AS c1,
 CASE WHEN abs(delta) < 0.0005 THEN 'WARN' ELSE 'PASS' END AS c2,
 CASE WHEN significant THEN 'PASS' ELSE 'WARN' END AS c3,
 CASE WHEN dominant IN ('mix', 'interaction') THEN 'WARN' ELSE 'PASS' END AS c4,
 CASE WHEN aov <= 0 OR sessions_t1 <= 0 OR abs(revenue_at_risk) > sessions_t1 * aov THEN 'FAIL'
  WHEN rate <> 0 AND (revenue_at_risk > 0) <> (rate > 0) THEN 'WARN' ELSE 'PASS' END AS c5,
 CASE WHEN NOT (conv_t0 BETWEEN 0 AND 1 AND conv_t1 BETWEEN 0 AND 1) OR {_broken(0)} OR {_broken(1)} THEN 'FAIL' ELSE 'PASS' END AS c6 FROM dg),
jd AS (SELECT *, CASE WHEN 'FAIL' IN (c1, c2, c3, c4, c5, c6) THEN 'REFUTE' WHEN 'WARN' IN (c1, c2, c3, c4, c5, c6) THEN 'REVISE' ELSE 'SHIP' END AS verdict FROM ck)"""
WEEK_DIAG = (WEEKLY, PAIRS, segments(), effects(), TOTALS, DIAG, CHECKS)
DAY_DIAG = (CELLS, PAIRS, segments(), effects(), TOTALS, DIAG, CHECKS)
_DIAG_COLUMNS = "w0, w1, " + ", ".join(f"{r(c, 6)} AS {c}" for c in ("conv_t0", "conv_t1", "delta", "mix", "rate", "interaction")) + \
    f", dominant, {r('p_value', 6)} AS p_value, significant, sessions_t1, {r('aov', 6)} AS aov, {r('revenue_at_risk', 6)} AS revenue_at_risk"
ORACLES["diagnosis_weeks"] = with_sessions(f"SELECT {_DIAG_COLUMNS} FROM jd", *WEEK_DIAG)
ORACLES["diagnosis_of_biggest_move"] = with_sessions(f"SELECT {_DIAG_COLUMNS} FROM jd JOIN big USING (w0, w1)", *WEEK_DIAG, BIGGEST)
ORACLES["diagnosis_days"] = with_sessions(f"SELECT {_DIAG_COLUMNS}, verdict FROM jd", *DAY_DIAG)
_driver = ", ".join(f"{r(f'{c} * 100', 6)} AS {n}" for c, n in (
    ("total", "total_pts"), ("mix", "mix_pts"), ("rate", "rate_pts"), ("r_t0", "conv_t0_pct"), ("r_t1", "conv_t1_pct")))
ORACLES["top_drivers"] = with_sessions(f"""
SELECT w0, w1, driver_rank, segment, {_driver}, CAST(round_even(w_t1 * sessions_t1, 0) AS BIGINT) AS sessions_t1
FROM ranked JOIN tot USING (w0, w1)""", *WEEK_DIAG)
ORACLES["funnel_totals"] = with_sessions("\nUNION ALL\n".join(
    f"SELECT w0, w1, CAST({s} AS BIGINT) AS side, " + ", ".join(f"{c}_t{s} AS {c}" for c in COUNT_NAMES) + " FROM tot" for s in (0, 1)
), WEEKLY, PAIRS, TOTALS)
ORACLES["revenue_at_risk"] = with_sessions(
    f"SELECT w0, w1, {r('rate', 6)} AS rate, sessions_t1, {r('aov', 6)} AS aov, {r('revenue_at_risk', 6)} AS revenue_at_risk FROM jd", *WEEK_DIAG)
NAMES = ("reconcile", "materiality", "significance", "mix-vs-rate framing", "dollar sanity", "data quality")
ORACLES["critic_verdict"] = with_sessions("\nUNION ALL\n".join(
    f"SELECT w0, w1, verdict, '{n}' AS name, c{i} AS status FROM jd" for i, n in enumerate(NAMES, start=1)), *DAY_DIAG)
ORACLES["critique_segments"] = with_sessions(f"""
, n AS (SELECT w0, w1, sum(den_t1) AS d1, {z_test('sum(num_t0)', 'sum(den_t0)', 'sum(num_t1)', 'sum(den_t1)')} AS z FROM segs GROUP BY 1, 2),
x AS (SELECT sm.*, z, d1, CASE WHEN abs(mix + rate + interaction - delta) <= greatest(0.005 * abs(delta), 1e-9) THEN 'PASS' ELSE 'FAIL' END AS c1,
 CASE WHEN abs(delta) < 0.0005 THEN 'WARN' ELSE 'PASS' END AS c2, CASE WHEN {SIGNIFICANT} THEN 'PASS' ELSE 'WARN' END AS c3,
 CASE WHEN dominant IN ('mix', 'interaction') THEN 'WARN' ELSE 'PASS' END AS c4, CASE WHEN abs(rate) > 1 THEN 'FAIL' ELSE 'PASS' END AS c5,
 CASE WHEN r_t0 BETWEEN 0 AND 1 AND r_t1 BETWEEN 0 AND 1 THEN 'PASS' ELSE 'FAIL' END AS c6 FROM sm JOIN n USING (w0, w1))
SELECT w0, w1, {r('delta')} AS delta, {_PARTS}, dominant, {r(p_value('z'))} AS p_value, {SIGNIFICANT} AS significant,
 CASE WHEN 'FAIL' IN (c1, c2, c3, c4, c5, c6) THEN 'REFUTE' WHEN 'WARN' IN (c1, c2, c3, c4, c5, c6) THEN 'REVISE' ELSE 'SHIP' END AS verdict,
 concat_ws(',', c1, c2, c3, c4, c5, c6) AS statuses FROM x""", CELLS, PAIRS, segments(), effects())
ORACLES["recommended_action"] = with_sessions("""
SELECT w0, w1, CASE WHEN verdict = 'REFUTE' THEN 'repair_data:' || CASE WHEN c1 = 'FAIL' THEN 'effects_sum'
   WHEN c5 = 'FAIL' THEN 'revenue_range' ELSE 'funnel_order_t0' END
 WHEN NOT significant THEN 'keep_watching'
 WHEN dominant = 'mix' THEN 'study_mix:' || top_segment ELSE 'study_rate:' || top_segment END AS action FROM jd""", *DAY_DIAG)
ORACLES["identity_check"] = with_sessions(f"""
, a AS (SELECT {WEEK} AS week, {counts()} FROM fct GROUP BY 1),
b AS (SELECT {WEEK} AS week, count(*) AS orders, {money('gross_revenue')} AS gross_revenue FROM ord GROUP BY 1),
c AS (SELECT *, revenue / sessions AS rps, purchasing_sessions / CAST(sessions AS DOUBLE) AS conv, gross_revenue / orders AS av,
 coalesce(CAST(view_item_sessions AS DOUBLE) / nullif(sessions, 0) * add_to_cart_sessions / nullif(view_item_sessions, 0) * begin_checkout_sessions / nullif(add_to_cart_sessions, 0)
  * purchasing_sessions / nullif(begin_checkout_sessions, 0), 0) AS chain FROM a LEFT JOIN b USING (week))
SELECT week, sessions, view_item_sessions, add_to_cart_sessions, begin_checkout_sessions, purchasing_sessions, {r('revenue')} AS revenue, orders,
 {r('gross_revenue')} AS gross_revenue, {r('rps')} AS revenue_per_session, {r('conv')} AS conversion, {r('av')} AS aov, {r('chain')} AS step_product,
 abs(rps - conv * av) <= 0.005 * abs(rps) AS revenue_identity, abs(conv - chain) <= 1e-9 AS conversion_identity FROM c""", ORDERS)
ORACLES["reconcile_totals"] = with_sessions("\nUNION ALL\n".join(
    f"SELECT *, abs(segment_total - canonical_total) <= 0.005 * abs(canonical_total) AS reconciles FROM (SELECT '{n}' AS measure, CAST((SELECT {a} FROM weekly) AS DOUBLE) AS segment_total, CAST({b} AS DOUBLE) AS canonical_total FROM fct)"
    for n, a, b in (
        ("sessions", "sum(sessions)", "count(*)"), ("purchasing_sessions", "sum(purchasing_sessions)", "count(*) FILTER (reached_purchase)"),
        ("revenue", money("revenue"), money("session_revenue")))), WEEKLY)

# ── drill-down: one group of CTEs per level ───────────────────────────────────
DRILL_DIMS = ("channel_group", "device_category", "landing_page")
_cells = f"""
weekly AS (SELECT {WEEK} AS week, {", ".join(DRILL_DIMS)}, {counts()} FROM fct GROUP BY ALL)"""


def _drill_level(depth: int, min_sessions: int, min_rate: float, alpha: float) -> str:
    labels = [f"'{d}=' || coalesce({d}, 'None')" for d in DRILL_DIMS]
    above = " || ' > ' || ".join(labels[: depth - 1]) or "''"
    side = lambda w, c: f"CAST(sum(CASE WHEN week = {w} THEN {c} ELSE 0 END) AS DOUBLE)"
    parents = "SELECT w0, w1, '' AS parent FROM pairs" if depth == 1 else f"SELECT w0, w1, node AS parent FROM nd{depth - 1}"
    share = lambda t: f"den_{t} / nullif(sum(den_{t}) OVER (PARTITION BY w0, w1, parent), 0)"
    return f"""
pr{depth} AS ({parents}),
sg{depth} AS (SELECT p.w0, p.w1, p.parent, {labels[depth - 1]} AS segment, {side('w0', 'purchasing_sessions')} AS num_t0, {side('w0', 'sessions')} AS den_t0,
  {side('w1', 'purchasing_sessions')} AS num_t1, {side('w1', 'sessions')} AS den_t1
 FROM pr{depth} p JOIN weekly ON week IN (p.w0, p.w1) AND {above} = p.parent GROUP BY 1, 2, 3, 4),
sh{depth} AS (SELECT *, {share('t0')} AS w_t0, {share('t1')} AS w_t1, coalesce(num_t0 / nullif(den_t0, 0), 0) AS r_t0, coalesce(num_t1 / nullif(den_t1, 0), 0) AS r_t1,
  {z_test('num_t0', 'den_t0', 'num_t1', 'den_t1')} AS z FROM sg{depth}),
ef{depth} AS (SELECT *, (w_t1 - w_t0) * r_t0 AS mix, w_t0 * (r_t1 - r_t0) AS rate, (w_t1 - w_t0) * (r_t1 - r_t0) AS interaction, {p_value('z')} AS p_value FROM sh{depth}),
nd{depth} AS (SELECT w0, w1, {depth} AS depth, parent, CASE WHEN parent <> '' THEN parent || ' > ' ELSE '' END || segment AS node,
  row_number() OVER (PARTITION BY w0, w1, parent ORDER BY abs(rate) DESC, segment) AS node_rank, den_t1, r_t0, r_t1, mix, rate, interaction, p_value
 FROM ef{depth} WHERE abs(rate) >= {min_rate} AND den_t1 >= {min_sessions} AND z IS NOT NULL AND p_value < {alpha})"""


_drilled = ", ".join(f"{r(c)} AS {c}" for c in ("r_t0", "r_t1", "mix", "rate", "interaction", "p_value"))
ORACLES["drill_tree"] = with_sessions("\nUNION ALL\n".join(
    f"SELECT w0, w1, depth, parent, node, node_rank, den_t1, {_drilled} FROM nd{d}" for d in (1, 2, 3)
), _cells, PAIRS, *(_drill_level(d, 5, 0.0005, 0.25) for d in (1, 2, 3)))

_MEASURES = [f"{c}_t{t}" for t in (0, 1) for c in ("num", "den", "revenue")]
_LINES = """
cells AS (
 SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS year, l_linestatus, r_name AS region, o_orderpriority, count(*) AS den,
  count(*) FILTER (l_returnflag = 'R') AS num, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS revenue
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 GROUP BY ALL),
years AS (SELECT DISTINCT year FROM cells),
pairs AS (SELECT a.year AS w0, b.year AS w1 FROM years a JOIN years b ON a.year < b.year)"""


def _leaf_level(depth: int, dims: tuple[str, ...]) -> str:
    labels = [f"'{d}=' || {d}" for d in dims]
    above = " || ' > ' || ".join(labels[: depth - 1]) or "''"
    side = lambda w, c: f"CAST(sum(CASE WHEN year = {w} THEN {c} ELSE 0 END) AS DOUBLE)"
    both = ", ".join(f"{side(f'w{m[-1]}', m[:-3])} AS {m}" for m in _MEASURES)
    parents = f"SELECT w0, w1, '' AS parent, {both} FROM pairs JOIN cells ON year IN (w0, w1) GROUP BY 1, 2" if depth == 1 else f"SELECT w0, w1, node AS parent, {', '.join(_MEASURES)} FROM nd{depth - 1}"
    share = lambda t: f"den_{t} / nullif(sum(den_{t}) OVER (PARTITION BY w0, w1, parent), 0)"
    agree = " AND ".join(f"abs(sum(s.{m}) OVER (PARTITION BY s.w0, s.w1, s.parent) - p.{m}) <= 0.005 * abs(p.{m})" for m in _MEASURES)
    return f"""
pr{depth} AS ({parents}),
sg{depth} AS (SELECT p.w0, p.w1, p.parent, {labels[depth - 1]} AS segment, {both.replace('THEN den', 'THEN cells.den').replace('THEN num', 'THEN cells.num').replace('THEN revenue', 'THEN cells.revenue')}
 FROM pr{depth} p JOIN cells ON year IN (p.w0, p.w1) AND {above} = p.parent GROUP BY 1, 2, 3, 4),
rc{depth} AS (SELECT s.*, {agree} AS reconciles FROM sg{depth} s JOIN pr{depth} p USING (w0, w1, parent)),
sh{depth} AS (SELECT *, {share('t0')} AS w_t0, {share('t1')} AS w_t1, coalesce(num_t0 / nullif(den_t0, 0), 0) AS r_t0, coalesce(num_t1 / nullif(den_t1, 0), 0) AS r_t1,
  {z_test('num_t0', 'den_t0', 'num_t1', 'den_t1')} AS z, coalesce(revenue_t1 / nullif(num_t1, 0), revenue_t0 / nullif(num_t0, 0), 0) AS aov FROM rc{depth}),
ef{depth} AS (SELECT *, (w_t1 - w_t0) * r_t0 AS mix, w_t0 * (r_t1 - r_t0) AS rate, (w_t1 - w_t0) * (r_t1 - r_t0) AS interaction, {p_value('z')} AS p_value FROM sh{depth}),
nd{depth} AS (SELECT w0, w1, {depth} AS depth, parent, CASE WHEN parent <> '' THEN parent || ' > ' ELSE '' END || segment AS node,
  row_number() OVER (PARTITION BY w0, w1, parent ORDER BY abs(rate) DESC, segment) AS node_rank, {', '.join(_MEASURES)}, r_t0, r_t1, mix, rate, interaction, p_value,
  reconciles, aov, (r_t0 - r_t1) * den_t1 * aov AS revenue_at_risk
 FROM ef{depth} WHERE abs(rate) >= 0.003 AND den_t1 >= 500 AND z IS NOT NULL AND p_value < 0.05)"""


_priced = ", ".join(f"{r(c)} AS {c}" for c in (*_MEASURES, "r_t0", "r_t1", "mix", "rate", "interaction", "p_value", "aov", "revenue_at_risk"))
ORACLES["drill_leaves"] = "WITH " + ",".join((_LINES, *(_leaf_level(d, ("l_linestatus", "region", "o_orderpriority")) for d in (1, 2, 3)), """
tree AS (SELECT * FROM nd1 UNION ALL SELECT * FROM nd2 UNION ALL SELECT * FROM nd3),
lv AS (SELECT *, NOT EXISTS (SELECT 1 FROM tree c WHERE c.w0 = tree.w0 AND c.w1 = tree.w1 AND c.parent = tree.node) AS leaf FROM tree)""")) + f"""
SELECT w0, w1, depth, parent, node, node_rank, {_priced}, reconciles, leaf,
 leaf AND reconciles AND abs(rate) > abs(mix) AND abs(rate) >= abs(interaction) AND abs(revenue_at_risk) > 1000 AS promoted FROM lv"""

# ── memory, experiments ───────────────────────────────────────────────────────
SEASON = "(VALUES (0, 'New Year', DATE '2024-01-01', DATE '2024-01-02'), (1, 'Sale', DATE '2024-01-15', DATE '2024-01-17')) cal(ordinal, event, a, b)"
NEW_YEAR = SEASON.replace(", (1, 'Sale', DATE '2024-01-15', DATE '2024-01-17')", "")


def season(calendar: str, lo: str, hi: str) -> str:
    return f"(SELECT arg_min(event, ordinal) FROM {calendar} WHERE a <= {hi} AND {lo} <= b)"


ORACLES["seasonal_overlap"] = with_sessions(f"""
SELECT week, day, {season(SEASON, 'week', 'week + 6')} AS week_season, {season(SEASON, 'day', 'day')} AS day_season
FROM (SELECT DISTINCT {WEEK} AS week, event_date AS day FROM fct)""")
FINDINGS = """
fk AS (SELECT *, CASE WHEN delta < 0 THEN 'down' ELSE 'up' END AS direction,
 dominant || '|' || top_segment || '|' || CASE WHEN delta < 0 THEN 'down' ELSE 'up' END AS key FROM jd)"""
ORACLES["findings_log"] = with_sessions(f"""
SELECT w1 + 1 AS as_of, w0, w1, key, dominant, top_segment AS segment, direction, {r('delta', 6)} AS delta, {r('revenue_at_risk', 6)} AS revenue_at_risk, verdict FROM fk""",
    *DAY_DIAG, FINDINGS)

_LOG = "lg AS (SELECT *, w1 AS as_of, CASE WHEN day(w1) % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id FROM fk)"
ORACLES["finding_log_recall"] = with_sessions(f"""
SELECT run_id, row_number() OVER (PARTITION BY key ORDER BY as_of DESC, w1 DESC, w0 DESC) AS recall_rank, as_of, w0, w1, key, direction, {r('delta', 6)} AS delta, verdict FROM lg""",
    *DAY_DIAG, FINDINGS, _LOG)
ORACLES["finding_log_latest"] = with_sessions(f"""
SELECT run_id, as_of, w0, w1, key, {r('delta', 6)} AS delta FROM lg WHERE as_of BETWEEN DATE '2024-01-08' AND DATE '2024-01-25'
QUALIFY row_number() OVER (PARTITION BY key ORDER BY as_of DESC, w1 DESC, w0 DESC) = 1""", *DAY_DIAG, FINDINGS, _LOG)
ORACLES["weeks"] = with_sessions(f"SELECT DISTINCT {WEEK} AS week FROM fct ORDER BY 1")


def decided(calendar: str, log: str, asked: int) -> str:
    return f"""
, lg AS ({log}),
x AS (SELECT w0, w1, key, delta, verdict, {season(calendar, 'w1', 'w1 + 6')} AS season,
 (SELECT max(day) FROM lg WHERE lg.key = fk.key AND day BETWEEN w1 + {asked} - 14 AND w1 + {asked}) AS prior_as_of FROM fk),
y AS (SELECT *, CASE WHEN season IS NOT NULL THEN 'SEASONAL' WHEN verdict = 'REFUTE' THEN 'REFUTED' WHEN abs(delta) < 0.0005 THEN 'IMMATERIAL'
 WHEN prior_as_of IS NOT NULL THEN 'REPEAT' ELSE 'NEW' END AS status FROM x)
SELECT w0, w1, key, season, prior_as_of, verdict, status, status <> 'NEW' AS suppressed,
 CASE WHEN verdict <> 'REFUTE' AND status = 'NEW' THEN 'SHIPPED' ELSE 'HELD' END AS gate FROM y"""


ORACLES["suppression"] = with_sessions(decided(SEASON, "SELECT key, w1 + 7 AS day FROM fk WHERE delta < 0", 14), *WEEK_DIAG, FINDINGS)
ORACLES["suppression_days"] = with_sessions(decided(NEW_YEAR, "SELECT key, w1 AS day FROM fk WHERE day(w1) % 2 = 0", 1), *DAY_DIAG, FINDINGS)
ORACLES["recall_prior"] = with_sessions("""
SELECT key, w0, w1, w1 - 1 AS asked_on, (SELECT max(o.w1) FROM fk o WHERE o.key = fk.key AND o.w1 BETWEEN fk.w1 - 15 AND fk.w1 - 1) AS prior_as_of FROM fk""", *DAY_DIAG, FINDINGS)
ORACLES["acknowledged"] = with_sessions("""
SELECT 'session_conversion_rate' AS metric, top_segment AS dimension_slice, dominant AS root_cause_label, w1 FROM fk
WHERE NOT EXISTS (SELECT 1 FROM fk o WHERE day(o.w1) % 3 = 0 AND o.w1 + 10 >= DATE '2024-01-25' AND o.top_segment = fk.top_segment AND o.dominant = fk.dominant)""",
    *DAY_DIAG, FINDINGS)
ORACLES["similar_findings"] = f"""
WITH q AS (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS c FROM embeddings),
s AS (SELECT vec_id, label, DATE '2024-06-01' - CAST(vec_id % 180 AS INT) AS as_of, vec_id % 180 AS age_days, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS similarity FROM embeddings, q)
SELECT vec_id, CAST(label AS BIGINT) AS label, as_of, age_days, {r('similarity', 6)} AS similarity, {r('similarity * exp(-age_days / 60.0)', 6)} AS score FROM s ORDER BY similarity * exp(-age_days / 60.0) DESC, vec_id LIMIT 10"""
ORACLES["recall_similar"] = f"""
WITH m AS (SELECT vec_id, DATE '2024-06-01' - CAST(vec_id % 180 AS INT) AS as_of, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (
 SELECT q.vec_id AS candidate_id, m.vec_id AS prior_id, list_cosine_similarity(m.v, q.v) AS similarity,
  list_cosine_similarity(m.v, q.v) * exp(-date_diff('day', m.as_of, DATE '2024-06-01' - CAST(q.vec_id % 7 AS INT)) / 60.0) AS score
 FROM m q JOIN m ON q.vec_id % 20 = 0 AND m.vec_id <> q.vec_id AND m.as_of <= DATE '2024-06-01' - CAST(q.vec_id % 7 AS INT)),
k AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY round(score, 12) DESC, prior_id) AS prior_rank FROM s)
SELECT candidate_id, prior_rank, prior_id, {r('similarity', 6)} AS similarity, {r('score', 6)} AS score FROM k WHERE prior_rank <= 10"""
_p1, _p2 = "p", "(p * 1.1::DOUBLE)"
_bar = f"(({_p1} + {_p2}) / 2)"
SIZE = f"""(CASE WHEN p > 0 AND p < 1 AND {_p2} < 1 THEN CAST(ceil(pow({Z95} * sqrt(2 * {_bar} * (1 - {_bar})) + {Z80} * sqrt({_p1} * (1 - {_p1}) + {_p2} * (1 - {_p2})), 2)
 / pow({_p2} - {_p1}, 2)) AS BIGINT) END)"""
SIZED = f"sz AS (SELECT *, {SIZE} AS n FROM pop)"
ORACLES["sample_size"] = with_sessions(f"""
SELECT segment, {r('p')} AS baseline_rate, n AS n_per_arm, CASE WHEN NOT (p > 0 AND p < 1) THEN 'baseline must lie between 0 and 1'
 WHEN NOT {_p2} < 1 THEN 'the lifted rate must lie between 0 and 1' END AS error FROM sz""",
    WEEKLY, BASE_SEGMENTS, "\npop AS (SELECT segment, num / CAST(den AS DOUBLE) AS p FROM bseg)", SIZED)
DESIGN = f"""SELECT {{keys}}segment, {r('p')} AS baseline_rate, {r('daily')} AS daily_eligible_sessions, n AS n_per_arm, n * 2 AS total_n, days AS runtime_days,
 {r('round_even(days / 7.0::DOUBLE, 1)')} AS runtime_weeks, coalesce(days <= 42, false) AS feasible, '50/50' AS split
 FROM (SELECT *, CASE WHEN daily > 0 THEN CAST(ceil(n * 2 / daily) AS BIGINT) END AS days FROM sz)"""
ORACLES["experiment_design"] = with_sessions(DESIGN.format(keys=""), WEEKLY, BASE_SEGMENTS,
    "\npop AS (SELECT segment, num / CAST(den AS DOUBLE) AS p, den / 30.0::DOUBLE AS daily FROM bseg)", SIZED)
ORACLES["recommended_experiment"] = with_sessions(DESIGN.format(keys="w0, w1, "), *DAY_DIAG, """
dr AS (SELECT r.w0, r.w1, r.segment, r.driver_rank, split_part(r.segment, ' / ', 2) AS device, r.r_t1, CAST(round_even(r.w_t1 * j.sessions_t1, 0) AS BIGINT) AS n1, j.top_segment
 FROM ranked r JOIN jd j ON r.w0 = j.w0 AND r.w1 = j.w1 WHERE j.verdict <> 'REFUTE' AND j.dominant = 'rate'),
pop AS (SELECT w0, w1, CASE WHEN count(*) > 1 THEN any_value(device) ELSE any_value(top_segment) END AS segment, sum(r_t1 * n1) / sum(n1) AS p, CAST(sum(n1) AS DOUBLE) / 7 AS daily
 FROM dr WHERE n1 > 0 AND device = split_part(top_segment, ' / ', 2) GROUP BY 1, 2)""", SIZED)
ORACLES["ice_backlog"] = with_sessions(f"""
SELECT w0, w1, {r('revenue_at_risk', 6)} AS revenue_at_risk, 0.1::DOUBLE AS expected_lift, {r('1 - p_value', 6)} AS confidence,
 CASE WHEN dominant = 'rate' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS ease,
 {r("abs(revenue_at_risk) * 0.1 * (1 - p_value) * CASE WHEN dominant = 'rate' THEN 1.0 ELSE 0.5 END", 6)} AS ice FROM jd""", *DAY_DIAG)


# ── benchmark ─────────────────────────────────────────────────────────────────
def injected(scenarios) -> str:
    rows = ", ".join(
        f"('{s.scenario_id}', '{s.bucket}', {s.target_rank}, {s.num_mult}::DOUBLE, {s.den_mult}::DOUBLE, {s.cons_mult}::DOUBLE, '{s.truth_effect}')" for s in scenarios)
    return f"""
spec(scenario_id, bucket, target_rank, nm, dm, cm, truth_effect) AS (VALUES {rows}),
br AS (SELECT *, row_number() OVER (ORDER BY den DESC, segment) AS rk FROM bseg),
segs AS (SELECT scenario_id, bucket, truth_effect, segment, target_rank > 0 AND target_rank = rk AS is_target,
 CAST(num AS DOUBLE) AS num_t0, CAST(den AS DOUBLE) AS den_t0, CAST(num AS DOUBLE) AS cons_t0,
 num * CASE WHEN target_rank IN (0, rk) THEN nm ELSE 1.0::DOUBLE END AS num_t1, den * CASE WHEN target_rank IN (0, rk) THEN dm ELSE 1.0::DOUBLE END AS den_t1,
 num * CASE WHEN target_rank IN (0, rk) THEN cm ELSE 1.0::DOUBLE END AS cons_t1 FROM br, spec)"""


TRUTH = """
truth AS (SELECT scenario_id, bucket, truth_effect, max(CASE WHEN is_target THEN segment END) AS truth_segment FROM segs GROUP BY 1, 2, 3)"""
BENCH = (WEEKLY, BASE_SEGMENTS, injected(DEFAULT_SCENARIOS), TRUTH, effects("scenario_id"), NAIVE.format(by="scenario_id"), """
bs AS (SELECT t.scenario_id, truth_segment, t.truth_effect, k.segment AS predicted_segment, sm.dominant AS predicted_effect, k.segment = truth_segment AS segment_correct,
 sm.dominant = t.truth_effect AS effect_correct, naive_segment, naive_segment = truth_segment AS naive_correct
 FROM truth t JOIN sm USING (scenario_id) JOIN ranked k ON k.scenario_id = t.scenario_id AND k.driver_rank = 1 JOIN naive ON naive.scenario_id = t.scenario_id)""")
ORACLES["inject_benchmark"] = with_sessions(
    f"SELECT * REPLACE ({r('num_t1')} AS num_t1, {r('den_t1')} AS den_t1, {r('cons_t1')} AS cons_t1) FROM segs", WEEKLY, BASE_SEGMENTS, injected(DEFAULT_SCENARIOS))
ORACLES["benchmark_scores"] = with_sessions("SELECT * FROM bs", *BENCH)
ORACLES["benchmark_accuracy"] = with_sessions(f"""
SELECT count(*) AS n, {r('avg(CAST(segment_correct AS INT))')} AS segment_accuracy, {r('avg(CAST(effect_correct AS INT))')} AS effect_accuracy,
 {r('avg(CAST(naive_correct AS INT))')} AS naive_accuracy FROM bs""", *BENCH)


def _rel(c: str) -> str:
    return f"abs({c}_t1 - {c}_t0) / greatest(abs({c}_t0), 1e-12)"


CLASSIFY = (WEEKLY, BASE_SEGMENTS, injected(LABELED_SCENARIOS), TRUTH, effects("scenario_id"), f"""
gr AS (SELECT *, CASE WHEN abs(mix) + abs(rate) + abs(interaction) < 1e-12 THEN 0 ELSE abs(mix) + abs(rate) + abs(interaction) END AS g, ({_rel('num')} > 0.10 AND {_rel('cons')} < 0.03) OR ({_rel('den')} > 0.10 AND {_rel('num')} < 0.03 AND {_rel('cons')} < 0.03)
  OR num_t1 > den_t1 * (1 + 1e-6) AS dq FROM eff),
tp AS (SELECT scenario_id, arg_min(segment, (-g, segment)) AS segment, sum(g) AS tg, sum(w_t0 * r_t0) AS r0, max(g) AS mg FROM gr GROUP BY 1),
cl0 AS (SELECT tp.scenario_id, tp.segment, mg / (CASE WHEN tg = 0 THEN 1e-12 ELSE tg END) AS concentration, (CASE WHEN tg = 0 THEN 1e-12 ELSE tg END) / greatest(abs(r0), 1e-12) AS activity,
 dq, abs(gr.mix) AS m, abs(gr.rate) AS rt FROM tp JOIN gr ON gr.scenario_id = tp.scenario_id AND gr.segment = tp.segment),
cl AS (SELECT *, CASE WHEN dq THEN 'data_quality' WHEN activity < 0.04 THEN 'none' WHEN concentration < 0.30 THEN 'none'
 WHEN least(m, rt) >= 0.35 * greatest(m, rt, 1e-12) THEN 'mixed' WHEN rt >= m THEN 'rate' ELSE 'mix' END AS effect FROM cl0),
sc AS (SELECT t.bucket, t.truth_effect, t.truth_segment, effect, CASE WHEN effect <> 'none' THEN cl.segment END AS segment,
 coalesce(effect <> 'none' AND cl.segment = truth_segment, false) AS hit FROM truth t JOIN cl USING (scenario_id)),
scd AS (SELECT *, CASE WHEN truth_effect IN ('data_quality', 'none') THEN effect = truth_effect ELSE effect = truth_effect AND hit END AS correct FROM sc)""")
ORACLES["classify_change"] = with_sessions(f"""
SELECT scenario_id, effect, CASE WHEN effect <> 'none' THEN segment END AS segment, {r('concentration')} AS concentration, {r('activity')} AS activity FROM cl""", *CLASSIFY)
ORACLES["labeled_accuracy"] = with_sessions(f"""
SELECT coalesce(bucket, '(all)') AS bucket, count(*) FILTER (correct) AS correct, count(*) AS n, {r('avg(CAST(correct AS INT))')} AS accuracy FROM scd GROUP BY ROLLUP (bucket)""", *CLASSIFY)
ORACLES["quality_gate"] = with_sessions(f"""
, q AS (SELECT avg(CAST(correct AS INT)) AS accuracy, coalesce(count(*) FILTER (truth_segment IS NOT NULL AND hit) / nullif(CAST(count(*) FILTER (truth_segment IS NOT NULL) AS DOUBLE), 0), 1) AS sa FROM scd)
SELECT {r('accuracy')} AS accuracy, {r('sa')} AS segment_accuracy, CAST(0 AS BIGINT) AS unknown_segments, accuracy >= 0.85 AND sa >= 0.85 AS passed FROM q""", *CLASSIFY)
