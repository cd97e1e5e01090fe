import datetime as dt

from pyspark.sql import functions as F

from funnelspark.functions.events import REACHED
from funnelspark.operators import attribution, checks, cohorts, daily, dims, orders, sessions
from tests.conftest import rows

STG = """session_key string, user_pseudo_id string, ga_session_id long, ga_session_number long, event_date date, event_timestamp timestamp,
 event_name string, page_location string, session_engaged string, engagement_time_msec long, event_source string, event_medium string,
 event_campaign string, gclid string, first_touch_source string, first_touch_medium string, first_touch_campaign string,
 device_category string, operating_system string, browser string, country string, region string, city string,
 transaction_id string, purchase_revenue_in_usd double"""
NAMES = [part.split()[0] for part in STG.replace("\n", " ").split(",")]
DAY = dt.date(2021, 1, 7)


def stg(spark, *events):
    data = []
    for i, e in enumerate(events):
        base = {"user_pseudo_id": "u1", "ga_session_id": 1, "event_date": DAY, "event_timestamp": dt.datetime(2021, 1, 7, 10, 0, i), "event_name": "page_view"}
        full = {**base, **e}
        data.append(tuple(full.get(n) for n in NAMES))
    return spark.createDataFrame(data, STG)


def test_flags_fill_all_earlier_steps(spark):
    steps = sessions.int_funnel_steps(stg(
        spark, {"session_key": "s1", "event_name": "purchase", "purchase_revenue_in_usd": 50.0},
        {"session_key": "s2", "event_name": "add_to_cart"}, {"session_key": "s3", "event_name": "view_item"}))
    got = rows(steps.select("session_key", *REACHED, "session_revenue"), "session_key")
    assert [[r[f] for f in REACHED] for r in got] == [[True] * 6, [True, True] + [False] * 4, [True] + [False] * 5]
    assert [r["session_revenue"] for r in got] == [50.0, 0.0, 0.0]


def test_revenue_counts_each_transaction_once(spark):
    buy = {"session_key": "s", "event_name": "purchase"}
    steps = sessions.int_funnel_steps(stg(
        spark, {**buy, "transaction_id": "A", "purchase_revenue_in_usd": 10.0}, {**buy, "transaction_id": "A", "purchase_revenue_in_usd": 12.0},
        {**buy, "transaction_id": "B", "purchase_revenue_in_usd": 5.0}, {**buy, "purchase_revenue_in_usd": 3.0}, {"session_key": "s"}))
    assert rows(steps)[0]["session_revenue"] == 20.0


def test_channel_engagement_and_landing_page(spark):
    got = rows(sessions.int_sessionized(stg(
        spark, {"session_engaged": "1", "event_source": "google", "event_medium": "cpc", "gclid": "abc", "page_location": None},
        {"event_source": "google", "event_medium": "cpc", "page_location": "/a"}, {"page_location": "/b", "ga_session_number": 1},
        {"user_pseudo_id": "u2", "event_source": "(direct)", "event_medium": "(none)", "first_touch_source": "bing"},
        {"user_pseudo_id": "u3", "first_touch_source": "facebook", "first_touch_medium": "cpc", "engagement_time_msec": 10000},
        {"user_pseudo_id": "u4", "ga_session_id": None})), "user_pseudo_id")
    assert [(r["channel_group"], r["engaged_session"], r["is_new_user"], r["landing_page"]) for r in got] == [
        ("Paid Search", True, True, "/a"), ("Direct", False, False, None), ("Paid Social", True, False, None)]


def test_rollup_equals_the_join_of_its_parts(marts):
    joined = sessions.fct_funnel(sessions.int_sessionized(marts.stg), sessions.int_funnel_steps(marts.stg)).select(*marts.funnel.columns)
    assert joined.exceptAll(marts.funnel).count() == 0 and marts.funnel.exceptAll(joined).count() == 0


def test_daily_counts_are_sums_of_sessions_and_monotonic(marts):
    counted = daily.fct_daily_funnel(marts.funnel)
    assert counted.exceptAll(daily.fct_daily_funnel(marts.funnel, distinct=True)).count() == 0
    total = rows(counted.agg(F.sum("sessions").alias("s"), F.sum("purchasing_sessions").alias("p")))[0]
    assert total == {"s": marts.funnel.count(), "p": marts.funnel.filter("reached_purchase").count()}
    assert counted.filter(checks.counts_not_monotonic(daily.COUNTS)).count() == 0
    weekly = daily.weekly_funnel(marts.funnel)
    assert weekly.exceptAll(daily.weekly_from_daily(counted).select(*weekly.columns)).count() == 0


def test_orders_without_a_session_keep_their_row(marts):
    found = marts.orders.filter("session_key IS NULL").select("channel_group", "device_category").distinct()
    assert all(r == {"channel_group": "Other", "device_category": None} for r in rows(found))
    assert marts.orders.count() == marts.raw.filter("event_name = 'purchase'").select("ecommerce.transaction_id").dropna().distinct().count()


def test_check_rules_find_broken_rows(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", -1, True), (None, 5, False)], "k string, n int, ok boolean")
    report = {r["rule"]: (r["checked"], r["violations"], r["status"]) for r in rows(checks.all_checks(
        checks.check_rows(df, {"null": checks.is_null("k"), "range": checks.outside("n", 0, 4), "expr": checks.is_false(F.col("ok")), "in": checks.not_in("k", ["b"])}),
        checks.check_unique(df, "unique", "k"),
        checks.check_relationship(df, "k", spark.createDataFrame([("b",)], "p string"), "p", "parent")))}
    assert report == {"null": (3, 1, "fail"), "range": (3, 2, "fail"), "expr": (3, 1, "fail"), "in": (3, 2, "fail"),
                      "unique": (2, 1, "fail"), "parent": (2, 2, "fail")}


def test_freshness_limits(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 30),)], "event_date date")
    status = [rows(checks.freshness(df, dt.datetime(2024, 1, 30) + dt.timedelta(hours=h)))[0]["status"] for h in (36, 37, 48, 49)]
    assert status == ["pass", "warn", "warn", "error"]


def session_table(spark, entries):
    """entries: user, day, channel, purchased"""
    data = [(f"{u}-{i}", u, dt.date(2024, 1, 1) + dt.timedelta(days=d), dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=i), c, p, 10.0)
            for i, (u, d, c, p) in enumerate(entries)]
    return spark.createDataFrame(data, "session_key string, user_pseudo_id string, event_date date, session_start_ts timestamp, channel_group string, reached_purchase boolean, session_revenue double")


def test_last_non_direct_against_brute_force(spark):
    import random
    rng = random.Random(5)
    # one user holds a third of all sessions
    entries = [(rng.choice(["hot", "u1", "u2"]) if i % 3 else "hot", rng.randrange(40), rng.choice(["Direct", "Direct", "Email", "Display"]), False) for i in range(300)]
    table = session_table(spark, entries)
    got = {r["session_key"]: r["last_non_direct_channel"] for r in rows(attribution.last_non_direct(table, 5))}
    all_rows = rows(table)
    for s in all_rows:
        seen = [o for o in all_rows if o["user_pseudo_id"] == s["user_pseudo_id"] and o["channel_group"] != "Direct"
                and (o["session_start_ts"], o["session_key"]) <= (s["session_start_ts"], s["session_key"])
                and (s["event_date"] - o["event_date"]).days <= 5]
        best = max(seen, key=lambda o: (o["session_start_ts"], o["session_key"]), default=None)
        assert got[s["session_key"]] == (best["channel_group"] if best else "Direct")


def test_retention_counts_the_second_active_day(spark):
    table = session_table(spark, [("a", 0, "Email", False), ("a", 0, "Email", False), ("a", 1, "Email", False), ("b", 0, "Email", False), ("b", 8, "Email", False), ("c", 0, "Email", False)])
    for c in ("source", "medium", "campaign", "device_category", "country"):
        table = table.withColumn(c, F.lit("x"))
    got = rows(cohorts.fct_cohorts(table.withColumn("is_new_user", F.lit(True))))[0]
    assert (got["cohort_size"], got["retained_users_d1"], got["retained_users_d7"], got["retained_users_d30"]) == (3, 1, 1, 2)


def test_item_versions_open_on_change(spark):
    seen = [("i", dt.datetime(2024, 1, d, h), "n", "c", p) for d, h, p in ((1, 1, 5.0), (1, 9, 6.0), (2, 1, 6.0), (4, 1, 7.0), (5, 1, 6.0))]
    obs = spark.createDataFrame(seen, "item_key string, observed_ts timestamp, item_name string, item_category string, price_in_usd double")
    got = rows(dims.snap_items(obs), "valid_from")
    assert [(r["price_in_usd"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day) for r in got] == [(6.0, 1, 4), (7.0, 4, 5), (6.0, 5, None)]


def test_order_counts_survive_a_hot_buyer(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"u{i}", i) for i in range(90)], "buyer_user_id string, order_key int")
    got = rows(orders.with_order_counts(df).groupBy("buyer_user_id").agg(F.max("user_order_count").alias("n"), F.count("*").alias("rows")))
    assert all(r["n"] == r["rows"] for r in got) and sum(r["rows"] for r in got) == 90
