import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from funnelspark.functions import events as E
from funnelspark.functions import numeric as N
from funnelspark.schema import EVENT_PARAMS
from tests.conftest import rows

# Source, medium, channel of the mapping seed.
SEED = (
    ("(direct)", "(none)", "Direct"), ("google", "cpc", "Paid Search"), ("bing", "cpc", "Paid Search"),
    ("google", "organic", "Organic Search"), ("bing", "organic", "Organic Search"), ("facebook", "cpc", "Paid Social"),
    ("instagram", "paid", "Paid Social"), ("facebook", "social", "Organic Social"), ("instagram", "social", "Organic Social"),
    ("youtube", "social", "Organic Social"), ("dv360", "display", "Display"), ("google", "display", "Display"),
    ("email", "email", "Email"), ("newsletter", "email", "Email"), ("partner", "affiliate", "Affiliates"),
    ("some-blog", "referral", "Referral"), ("t.co", "referral", "Referral"), ("other", "unknown", "Other"),
)


def test_channel_rules_agree_with_the_seed_and_keep_their_order(spark):
    cases = [(s, m, None, c) for s, m, c in SEED] + [
        ("google", "cpm", None, "Paid Search"), ("(direct)", "(none)", "abc", "Direct"), ("other", "x", "abc", "Paid Search"),
        (None, None, None, "Direct"), (None, "email", None, "Email"), ("GOOGLE", "CPC", None, "Paid Search"), ("blog", None, None, "Other"),
    ]
    df = spark.createDataFrame(cases, "s string, m string, g string, expected string")
    bad = df.withColumn("got", E.channel_group("s", "m", "g")).filter("got <> expected")
    assert rows(bad) == []


def test_event_param_takes_the_first_match_and_null_when_absent(spark):
    value = lambda s=None, i=None: {"string_value": s, "int_value": i, "float_value": None, "double_value": None}
    data = [
        (1, [{"key": "a", "value": value("x")}, {"key": "a", "value": value("y")}, {"key": "n", "value": value(i=5)}]),
        (2, []), (3, None), (4, [{"key": "it's", "value": value("q")}]),
    ]
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("event_params", EVENT_PARAMS)])
    got = rows(spark.createDataFrame(data, schema).select(
        "id", E.event_param("a").alias("a"), E.event_param("n", "int").alias("n"), E.event_param("it's").alias("q")), "id")
    assert [(r["a"], r["n"], r["q"]) for r in got] == [("x", 5, None), (None, None, None), (None, None, None), (None, None, "q")]


def test_session_key_is_null_without_a_session(spark):
    df = spark.createDataFrame([("u", 1), ("u", None), (None, 1)], "user_pseudo_id string, ga_session_id long")
    keys = [r["k"] for r in rows(df.select(E.session_key().alias("k")))]
    import hashlib
    assert keys == [hashlib.md5(b"u-1").hexdigest(), None, None]


def test_step_flags_mark_the_step_and_all_before_it(spark):
    df = spark.createDataFrame([("purchase",), ("add_to_cart",), ("page_view",)], "event_name string")
    got = [list(r.values()) for r in rows(df.select(*E.step_flags()))]
    assert got == [[True] * 6, [True, True] + [False] * 4, [False] * 6]


def test_buckets_labels_and_literals(spark):
    df = spark.createDataFrame([(5,), (1,), (9,), (None,)], "n int")
    got = rows(df.select(E.session_number_bucket("n").alias("bucket"), E.segment_label("n", F.lit(None).cast("string")).alias("label")))
    assert [r["bucket"] for r in got] == ["4-6", "1", "7+", None]
    assert got[0]["label"] == "5 / None"
    typed = rows(df.select(E.typed_literal("2024-02-14").alias("d"), E.typed_literal("2024").alias("t"), E.typed_literal(True).alias("b")).limit(1))[0]
    assert typed == {"d": dt.date(2024, 2, 14), "t": "2024", "b": True}


def test_calendar_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 11),)], "event_date date")
    assert rows(df.select(*E.calendar_parts())) == [
        {"year": 2024, "quarter": 1, "month": 2, "week": 6, "day_of_week": 1, "day_name": "Sunday", "is_weekend": True}]


def test_weekly_and_quarterly_grain(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 14),)], "d date")
    got = [rows(df.select(E.time_grain("d", g).alias("x")))[0]["x"] for g in ("week", "month", "quarter")]
    assert got == [dt.date(2024, 2, 12), dt.date(2024, 2, 1), dt.date(2024, 1, 1)]
    with pytest.raises(ValueError):
        E.time_grain("d", "decade")


def test_normal_functions_match_the_standard_library(spark):
    xs = [-9.0, -4.0, -1.3, -0.4688, -0.3, 0.0, 0.2, 0.46875, 0.47, 1.0, 2.5, 4.0, 4.0001, 6.0, 12.0, 25.0]
    for r in rows(spark.createDataFrame([(x,) for x in xs], "x double").select("x", N.erfc("x").alias("e"), N.normal_cdf("x").alias("c"))):
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=1e-13)
        assert r["c"] == pytest.approx(statistics.NormalDist().cdf(r["x"]), rel=1e-9, abs=1e-15)
    ps = [1e-12, 1e-5, 0.02, 0.07, 0.3, 0.5, 0.8, 0.925, 0.975, 1 - 1e-9]
    for r in rows(spark.createDataFrame([(p,) for p in ps], "p double").select("p", N.normal_ppf("p").alias("z"))):
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-15)
    edge = rows(spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(N.normal_ppf("p").alias("z")))
    assert [r["z"] for r in edge] == [None, None, None]


def test_safe_divide_gives_null_for_zero(spark):
    got = rows(spark.createDataFrame([(1, 0), (1, 4)], "a long, b long").select(N.safe_divide("a", "b").alias("x"), N.rate_or_zero("a", "b").alias("y")))
    assert [(r["x"], r["y"]) for r in got] == [(None, 0.0), (0.25, 0.25)]
