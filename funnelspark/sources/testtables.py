"""Maps the supplied test tables onto the nested raw event schema.

The rules are those of FIXTURES.md section 4; the oracle SQL repeats them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.schema import TEST_TABLES

# Fixed values of the mapping: source/medium pair per index.
CHANNEL_PAIRS = (
    ("(direct)", "(none)"), ("google", "organic"), ("google", "cpc"), ("dv360", "display"),
    ("facebook", "cpc"), ("instagram", "social"), ("newsletter", "email"), ("partner", "affiliate"),
    ("some-blog", "referral"), ("other", "unknown"), ("bing", "organic"), ("youtube", "social"),
)
DEVICES = ("mobile", "desktop", "tablet")
SYSTEMS = ("Windows", "Macintosh", "iOS", "Android")
BROWSERS = ("Chrome", "Safari", "Edge", "Firefox")

# Fixed values of the mapping: factors that spread the items of events over all parts.
ITEM_FACTORS = (7919, 104729)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(TEST_TABLES[name]) if name in TEST_TABLES else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values, index: str) -> str:
    """SQL: the entry of a fixed list."""
    return "get(array({}), cast({} AS INT))".format(", ".join(f"'{v}'" for v in values), index)


SOURCES, MEDIUMS = ([pair[i] for pair in CHANNEL_PAIRS] for i in (0, 1))

FLAT = (
    "event_id", "user_id", "event_type", "value",
    "CAST(get_json_object(props, '$.k') AS INT) AS k",
    "CAST(ts AS DATE) AS event_date",
    "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS micros",
    "unix_date(CAST(ts AS DATE)) AS d",
)

EVENT_NAME = """
CASE event_type
  WHEN 'view' THEN 'view_item'
  WHEN 'click' THEN 'add_to_cart'
  WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN 'begin_checkout' WHEN 1 THEN 'add_shipping_info' ELSE 'add_payment_info' END
  WHEN 'purchase' THEN if(k % 5 = 0, 'purchase', 'page_view')
  ELSE 'page_view'
END AS event_name"""

# parameter -> slot and value; a NULL value leaves the parameter out
PARAMS = {
    "ga_session_id": ("int", "if(event_id % 50 <> 0, d, NULL)"),
    "ga_session_number": ("int", "session_number"),
    "page_location": ("string", "if(k % 10 <> 9, concat('/p/', k), NULL)"),
    "session_engaged": ("string", "if(k % 4 = 0, '1', NULL)"),
    "engagement_time_msec": ("int", "floor(CAST(value AS DECIMAL(18,2)) * 100)"),
    "source": ("string", f"if(event_id % 4 <> 0, {_pick(SOURCES, 'pair')}, NULL)"),
    "medium": ("string", f"if(event_id % 4 <> 0, {_pick(MEDIUMS, 'pair')}, NULL)"),
    "campaign": ("string", "if(event_id % 4 <> 0 AND pair IN (2, 3, 4), concat('cmp', pair), NULL)"),
    "gclid": ("string", "if(pair = 2 AND user_id % 2 = 0, concat('g', user_id), NULL)"),
}


def _param(key: str, slot: str, value: str) -> str:
    text = value if slot == "string" else "NULL"
    number = value if slot == "int" else "NULL"
    return f"""named_struct('key', '{key}', 'value', named_struct(
      'string_value', CAST({text} AS STRING), 'int_value', CAST({number} AS BIGINT),
      'float_value', CAST(NULL AS DOUBLE), 'double_value', CAST(NULL AS DOUBLE)))"""


EVENT_PARAMS = "filter(array({}), p -> p.value.string_value IS NOT NULL OR p.value.int_value IS NOT NULL) AS event_params".format(
    ",\n".join(_param(key, slot, value) for key, (slot, value) in PARAMS.items())
)


def _amount(share: str) -> str:
    """SQL: share of ``value`` in whole cents, rounded in decimal arithmetic."""
    return f"CAST(round(CAST(value AS DECIMAL(18,2)) * CAST({share} AS DECIMAL(3,2)), 2) AS DOUBLE)"


RAW = (
    "event_date",
    "event_name",
    "micros AS event_timestamp",
    "concat('u', user_id) AS user_pseudo_id",
    "CAST(NULL AS STRING) AS user_id",
    EVENT_PARAMS,
    f"""named_struct('source', {_pick(SOURCES, 'user_id % 12')}, 'medium', {_pick(MEDIUMS, 'user_id % 12')},
      'name', concat('ft', user_id % 12)) AS traffic_source""",
    f"""named_struct('category', {_pick(DEVICES, 'user_id % 3')}, 'operating_system', {_pick(SYSTEMS, 'user_id % 4')},
      'language', CAST(NULL AS STRING), 'web_info', named_struct('browser', {_pick(BROWSERS, 'user_id % 4')})) AS device""",
    "named_struct('country', country, 'region', region, 'city', CAST(NULL AS STRING)) AS geo",
    f"""named_struct(
      'transaction_id', if(bought AND event_id % 20 <> 0, concat('T', user_id, '-', d), NULL),
      'purchase_revenue_in_usd', if(bought, value, NULL),
      'refund_value_in_usd', if(bought AND k % 10 = 0, {_amount('0.5')}, NULL),
      'shipping_value_in_usd', if(bought, {_amount('0.1')}, NULL),
      'tax_value_in_usd', if(bought, {_amount('0.08')}, NULL),
      'total_item_quantity', if(bought, 1 + event_id % 3, NULL),
      'unique_items', if(bought, 1L, NULL)) AS ecommerce""",
)


def _item(part: str) -> str:
    return f"""if({part}.p_partkey IS NOT NULL, named_struct(
      'item_id', CAST({part}.p_partkey AS STRING), 'item_name', {part}.p_name, 'item_brand', {part}.p_brand,
      'item_category', {part}.p_type, 'price_in_usd', {part}.p_retailprice, 'quantity', 1 + event_id % 3,
      'item_revenue_in_usd',
      if(event_name = 'purchase', CAST(CAST({part}.p_retailprice AS DECIMAL(18,2)) * (1 + event_id % 3) AS DOUBLE), NULL)), NULL)"""


ITEMS = f"""if(event_name IN ('view_item', 'purchase'),
  array_compact(array({_item('first')}, if(k % 3 = 0, {_item('second')}, NULL))), NULL) AS items"""


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with the helper columns of the mapping."""
    return read_table(spark, sf_dir, "events").selectExpr(*FLAT)


def _with_session_number(events: DataFrame) -> DataFrame:
    """Rank of each day among the user's days.

    Distinct days combine on the map side, so even a user with a third of all
    events gathers one small integer per calendar day. The events are joined on
    (user, day), which spreads such a user over as many tasks as days.
    """
    days = (
        events.groupBy("user_id").agg(F.expr("array_sort(collect_set(d)) AS days"))
        .selectExpr("user_id", "posexplode(days) AS (position, d)")
        .selectExpr("user_id", "d", "position + 1L AS session_number")
    )
    return events.join(days, ["user_id", "d"])


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    joined = nation.join(region, F.expr("n_regionkey = r_regionkey"), "left")
    return joined.selectExpr("n_nationkey", "n_name AS country", "r_name AS region")


def _join_parts(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins the one or two parts an event names, out of all parts; events without items name none."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    count = parts.agg(F.count(F.lit(1))).scalar()
    shows = F.col("event_name").isin("view_item", "purchase")
    named = events.withColumns({
        "first_part": F.when(shows, F.pmod(F.col("event_id") * ITEM_FACTORS[0] + F.col("k"), count)),
        "second_part": F.when(shows & (F.col("k") % 3 == 0), F.pmod(F.col("event_id") * ITEM_FACTORS[1] + F.col("k") * 7, count)),
    })
    with_first = named.join(parts.alias("first"), F.expr("first_part = first.p_partkey"), "left")
    return with_first.join(parts.alias("second"), F.expr("second_part = second.p_partkey"), "left")


def raw_events(spark: SparkSession, sf_dir: str, items: bool = False) -> DataFrame:
    """Nested raw events. ``items`` adds the line items (two joins with the parts)."""
    events = _with_session_number(flat_events(spark, sf_dir))
    events = events.join(_geo(spark, sf_dir), F.expr("user_id % 25 = n_nationkey"), "left")
    named = events.selectExpr("*", EVENT_NAME, "(user_id + d) % 12 AS pair")
    named = named.selectExpr("*", "event_name = 'purchase' AS bought")
    if not items:
        return named.selectExpr(*RAW)
    return _join_parts(named, spark, sf_dir).selectExpr(*RAW, ITEMS)
