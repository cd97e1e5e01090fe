"""Typed event and parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import event_param, param_text, session_key

PARAMS = {
    "ga_session_id": ("ga_session_id", "int"),
    "ga_session_number": ("ga_session_number", "int"),
    "page_location": ("page_location", "string"),
    "session_engaged": ("session_engaged", "string"),
    "engagement_time_msec": ("engagement_time_msec", "int"),
    "event_source": ("source", "string"),
    "event_medium": ("medium", "string"),
    "event_campaign": ("campaign", "string"),
    "gclid": ("gclid", "string"),
}

STRUCT_FIELDS = {
    "first_touch_source": "traffic_source.source",
    "first_touch_medium": "traffic_source.medium",
    "first_touch_campaign": "traffic_source.name",
    "device_category": "device.category",
    "operating_system": "device.operating_system",
    "browser": "device.web_info.browser",
    "device_language": "device.language",
    "country": "geo.country",
    "region": "geo.region",
    "city": "geo.city",
    "transaction_id": "ecommerce.transaction_id",
    "purchase_revenue_in_usd": "ecommerce.purchase_revenue_in_usd",
    "refund_value_in_usd": "ecommerce.refund_value_in_usd",
    "shipping_value_in_usd": "ecommerce.shipping_value_in_usd",
    "tax_value_in_usd": "ecommerce.tax_value_in_usd",
    "total_item_quantity": "ecommerce.total_item_quantity",
}


def stg_events(raw: DataFrame) -> DataFrame:
    """One flat, typed row per event. One projection, no shuffle."""
    typed = raw.select(
        "event_date",
        "event_name",
        F.timestamp_micros("event_timestamp").alias("event_timestamp"),
        "user_pseudo_id",
        "user_id",
        *[event_param(key, kind).alias(name) for name, (key, kind) in PARAMS.items()],
        *[F.col(path).alias(name) for name, path in STRUCT_FIELDS.items()],
    )
    return typed.select(session_key().alias("session_key"), "*")


def stg_event_params(raw: DataFrame) -> DataFrame:
    """One row per event and parameter; events without parameters give none."""
    exploded = raw.select(
        "event_date",
        "event_name",
        F.timestamp_micros("event_timestamp").alias("event_timestamp"),
        "user_pseudo_id",
        F.explode("event_params").alias("param"),
    )
    return exploded.select(
        "event_date", "event_name", "event_timestamp", "user_pseudo_id",
        F.col("param.key").alias("param_key"),
        "param.value.string_value", "param.value.int_value",
        "param.value.float_value", "param.value.double_value",
        param_text("param.value").alias("value_string"),
    )
