"""Explicit schemas of the raw event table, the seed and the finding log."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

PARAM_VALUE = _struct(string_value=_S, int_value=_L, float_value=_D, double_value=_D)
EVENT_PARAMS = T.ArrayType(_struct(key=_S, value=PARAM_VALUE))
ITEM = _struct(
    item_id=_S, item_name=_S, item_brand=_S, item_category=_S,
    price_in_usd=_D, quantity=_L, item_revenue_in_usd=_D,
)

RAW_EVENT = _struct(
    event_date=T.DateType(),
    event_name=_S,
    event_timestamp=_L,
    user_pseudo_id=_S,
    user_id=_S,
    event_params=EVENT_PARAMS,
    traffic_source=_struct(source=_S, medium=_S, name=_S),
    device=_struct(category=_S, operating_system=_S, language=_S, web_info=_struct(browser=_S)),
    geo=_struct(country=_S, region=_S, city=_S),
    ecommerce=_struct(
        transaction_id=_S, purchase_revenue_in_usd=_D, refund_value_in_usd=_D,
        shipping_value_in_usd=_D, tax_value_in_usd=_D, total_item_quantity=_L, unique_items=_L,
    ),
    items=T.ArrayType(ITEM),
)

CHANNEL_SEED = _struct(source=_S, medium=_S, channel_group=_S)

FINDING = _struct(
    as_of=T.DateType(), w0=T.DateType(), w1=T.DateType(), key=_S, dominant=_S, segment=_S,
    direction=_S, delta=_D, revenue_at_risk=_D, verdict=_S,
)

# Schemas of the supplied test tables that this engine reads.
TEST_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
