import datetime as dt

import pytest
from pyspark.sql import functions as F

from funnelspark.operators import diagnosis, memory, verdict
from funnelspark.operators.daily import COUNTS
from tests.conftest import rows

D = dt.date
WEEKS = [D(2024, 3, 4) + dt.timedelta(days=7 * i) for i in range(10)]


def weekly(spark, rates, sessions=10000):
    data = []
    for w, rate in zip(WEEKS, rates):
        for device, share in (("mobile", 0.6), ("desktop", 0.4)):
            n = int(sessions * share)
            bought = round(n * rate)
            data.append((w, "Direct", device, n, n // 2, n // 4, n // 5, n // 6, n // 7, bought, bought * 50.0))
    return spark.createDataFrame(data, "week date, channel_group string, device_category string, " + ", ".join(f"{c} long" for c in COUNTS) + ", revenue double")


STEADY = [0.0200, 0.0202, 0.0198, 0.0201, 0.0199, 0.0200, 0.0203, 0.0197, 0.0200]


def test_selectors(spark):
    found = rows(diagnosis.select_move(weekly(spark, [*STEADY, 0.012]), "anomaly"))[0]
    assert (found["w0"], found["w1"]) == (WEEKS[8], WEEKS[9])
    biggest = rows(diagnosis.select_move(weekly(spark, [0.02, 0.03, 0.02]), "delta"))[0]
    assert biggest["w0"] in WEEKS[:2]
    calm = rows(diagnosis.select_move(weekly(spark, [0.02, 0.021]), "anomaly"))[0]
    assert (calm["w0"], calm["w1"]) == (WEEKS[0], WEEKS[1])
    single = rows(diagnosis.select_move(weekly(spark, [0.02]), "anomaly"))[0]
    assert single["w0"] == single["w1"] == WEEKS[0]
    with pytest.raises(ValueError):
        diagnosis.select_move(weekly(spark, [0.02]), "guess")


def test_diagnosis_of_a_rate_drop(spark):
    w = weekly(spark, [0.04, 0.02])
    d = rows(verdict.critique(diagnosis.diagnose(w, diagnosis.adjacent_pairs(w))))[0]
    assert d["dominant"] == "rate" and d["delta"] == pytest.approx(-0.02) and d["significant"] and d["aov"] == pytest.approx(50.0)
    assert d["revenue_at_risk"] == pytest.approx(-0.02 * 10000 * 50) and d["verdict"] == "SHIP"
    assert [x["segment"] for x in d["drivers"]] == ["Direct / mobile", "Direct / desktop"] and d["drivers"][0]["sessions_t1"] == 6000
    assert d["funnel_t1"]["sessions"] == 10000


GOOD = {"w0": WEEKS[0], "w1": WEEKS[1], "delta": -0.02, "mix": 0.0, "rate": -0.02, "interaction": 0.0, "dominant": "rate", "conv_t0": 0.04,
        "conv_t1": 0.02, "p_value": 1e-9, "significant": True, "sessions_t1": 10000, "aov": 50.0, "revenue_at_risk": -10000.0}


def case(spark, funnel=(100, 90, 80, 70, 60, 50, 40), **changed):
    values = {**GOOD, **changed}
    df = spark.createDataFrame([tuple(values.values())], "w0 date, w1 date, delta double, mix double, rate double, interaction double, dominant string, conv_t0 double, "
                               "conv_t1 double, p_value double, significant boolean, sessions_t1 long, aov double, revenue_at_risk double")
    steps = F.struct(*[F.lit(n).alias(c) for n, c in zip(funnel, COUNTS)])
    driver = F.array(F.struct(F.lit("Direct / mobile").alias("segment")))
    return df.select("*", driver.alias("drivers"), steps.alias("funnel_t0"), steps.alias("funnel_t1"))


@pytest.mark.parametrize("changed, check, status, final", [
    ({}, "reconcile", "PASS", "SHIP"),
    ({"mix": 0.01}, "reconcile", "FAIL", "REFUTE"),
    ({"delta": -0.0001, "rate": -0.0001, "revenue_at_risk": -50.0}, "materiality", "WARN", "REVISE"),
    ({"significant": False}, "significance", "WARN", "REVISE"),
    ({"dominant": "mix"}, "mix-vs-rate framing", "WARN", "REVISE"),
    ({"dominant": "interaction"}, "mix-vs-rate framing", "WARN", "REVISE"),
    ({"aov": 0.0}, "dollar sanity", "FAIL", "REFUTE"),
    ({"revenue_at_risk": -1e9}, "dollar sanity", "FAIL", "REFUTE"),
    ({"revenue_at_risk": 10000.0}, "dollar sanity", "WARN", "REVISE"),
    ({"conv_t1": 1.2}, "data quality", "FAIL", "REFUTE"),
    ({"funnel": (100, 90, 95, 70, 60, 50, 40)}, "data quality", "FAIL", "REFUTE"),
])
def test_one_broken_field_per_check(spark, changed, check, status, final):
    got = rows(verdict.critique(case(spark, **changed)))[0]
    assert {c["name"]: c["status"] for c in got["checks"]}[check] == status and got["verdict"] == final


def test_seasons_by_week_and_day(spark):
    weeks = spark.createDataFrame([(D(2020, 11, 23),), (D(2021, 1, 4),), (D(2020, 12, 7),), (D(2020, 12, 28),)], "w date")
    got = {r["w"]: r["season"] for r in rows(memory.event_for_week(weeks, "w", memory.seasonal_calendar(spark)))}
    assert got == {D(2020, 11, 23): "Black Friday", D(2021, 1, 4): "Post-holiday January trough", D(2020, 12, 7): None, D(2020, 12, 28): "New Year"}
    day = spark.createDataFrame([(D(2021, 1, 2),), (D(2021, 1, 16),)], "d date")
    assert {r["season"] for r in rows(memory.event_on(day, "d", memory.seasonal_calendar(spark)))} == {"New Year", None}


def test_new_finding_becomes_a_repeat_and_others_stay_silent(spark, tmp_path):
    from funnelspark.sources.findings import append_findings, read_findings

    path, calendar, today = str(tmp_path / "findings"), memory.seasonal_calendar(spark), D(2024, 3, 18)
    judged = verdict.critique(case(spark))

    def status(df, as_of):
        return rows(memory.suppress(df, read_findings(spark, path), calendar, F.lit(as_of)).withColumn("gate", verdict.ship_gate()))[0]

    assert read_findings(spark, path).count() == 0
    first = status(judged, today)
    assert (first["status"], first["suppressed"], first["gate"]) == ("NEW", False, "SHIPPED") and first["key"] == "rate|Direct / mobile|down"
    append_findings(memory.to_findings(judged, F.lit(today)), path)
    assert [status(judged, today + dt.timedelta(days=n))["status"] for n in (-1, 0, 14, 15)] == ["NEW", "REPEAT", "REPEAT", "NEW"]
    assert status(verdict.critique(case(spark, aov=0.0)), today)["status"] == "REFUTED"
    assert status(verdict.critique(case(spark, delta=-0.0001, rate=-0.0001, revenue_at_risk=-50.0)), today)["status"] == "IMMATERIAL"
    assert status(verdict.critique(case(spark, w1=D(2020, 11, 23))), today)["status"] == "SEASONAL"
    append_findings(memory.to_findings(judged, F.lit(today + dt.timedelta(days=3))), path)
    recalled = rows(memory.recall_prior(read_findings(spark, path), first["key"], today + dt.timedelta(days=2), 14))
    assert [r["as_of"] for r in recalled] == [today]
    assert [r["as_of"].day for r in rows(memory.recall_prior(read_findings(spark, path), first["key"]))] == [21, 18]


def test_reconcile_total_of_zero(spark):
    df = spark.createDataFrame([(10000.0, 10040.0), (10000.0, 11000.0), (0.0, 0.0), (1.0, 0.0)], "a double, b double")
    assert [r["ok"] for r in rows(df.select(verdict.reconciles("a", "b").alias("ok")))] == [True, False, True, False]


def test_drill_finds_the_planted_slice(spark):
    data = []
    for w, period in enumerate(WEEKS[:2]):
        for channel in ("Direct", "Email"):
            for device in ("mobile", "desktop"):
                rate = 0.02 if w and (channel, device) == ("Email", "mobile") else 0.06
                data.append((period, channel, device, 5000, int(5000 * rate)))
    cells = spark.createDataFrame(data, "week date, channel_group string, device_category string, sessions long, purchasing_sessions long")
    tree = rows(diagnosis.drill_tree(cells, diagnosis.adjacent_pairs(cells), ("channel_group", "device_category")), "depth", "node")
    assert [r["node"] for r in tree] == ["channel_group=Email", "channel_group=Email > device_category=mobile"]


def test_leaves_of_the_drill_down_are_priced_and_reconciled(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]
    cells = [
        # one cell of channel a lost half of its purchases; the rest stays as it was
        *((d, c, v, 2000, 40 if (c, v, i) == ("a", "x", 1) else 100, 10.0 * (40 if (c, v, i) == ("a", "x", 1) else 100)) for i, d in enumerate(days) for c in "ab" for v in "xy"),
        *((d, "small", "x", 400, 10 + 90 * i, 10.0 * (10 + 90 * i)) for i, d in enumerate(days)),
    ]
    frame = spark.createDataFrame(cells, "week date, channel string, device string, sessions long, purchasing_sessions long, revenue double")
    pairs = spark.createDataFrame([tuple(days)], "w0 date, w1 date")
    tree = {r["node"]: r for r in rows(diagnosis.drill_tree(frame, pairs, ("channel", "device")))}
    assert set(tree) == {"channel=a", "channel=a > device=x"}
    leaf, top = tree["channel=a > device=x"], tree["channel=a"]
    assert leaf["leaf"] and leaf["promoted"] and leaf["reconciles"] and not top["leaf"] and not top["promoted"]
    assert leaf["aov"] == 10.0 and leaf["revenue_at_risk"] == pytest.approx((100 - 40) / 2000 * 2000 * 10.0)
    assert top["num_t0"] == 200 and top["revenue_t1"] == 1400.0
    # totals that the cells don't add up to: nothing is promoted at the level that misses them
    off = frame.groupBy("week").agg(*(F.sum(c).alias(c) for c in ("sessions", "purchasing_sessions", "revenue"))).withColumn("revenue", F.col("revenue") * 1.01)
    drifted = rows(diagnosis.drill_tree(frame, pairs, ("channel",), canonical=off))
    assert [(r["node"], r["reconciles"], r["leaf"], r["promoted"]) for r in drifted] == [("channel=a", False, True, False)]
    # bounds that keep nothing end the search at once
    assert diagnosis.drill_tree(frame, pairs, ("channel", "device", "week"), min_rate_effect=0.5).count() == 0
    assert diagnosis.drill_tree(frame, pairs, ("channel", "device"), min_revenue=1e6).filter("promoted").count() == 0
