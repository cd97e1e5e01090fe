"""Orders and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.functions.events import event_param, session_key
from funnelspark.functions.numeric import money
from funnelspark.sources.events import date_window

# session columns carried on every order
ORDER_DIMS = ("channel_group", "source", "medium", "campaign", "device_category", "country", "region", "is_new_user")


def raw_purchases(raw: DataFrame, start=None, end=None) -> DataFrame:
    """Purchase events with a transaction id, inside the date window."""
    bought = date_window(raw, start, end).filter(
        (F.col("event_name") == "purchase") & F.col("ecommerce.transaction_id").isNotNull()
    )
    order_ts = F.timestamp_micros("event_timestamp")
    columns = [
        F.col("ecommerce.transaction_id").alias("order_key"),
        order_ts.alias("order_ts"),
        session_key("user_pseudo_id", event_param("ga_session_id", "int")).alias("session_key"),
        F.col("user_pseudo_id"),
        F.to_date(order_ts).alias("event_date"),
        F.col("ecommerce.purchase_revenue_in_usd").alias("gross_revenue"),
        F.col("ecommerce.refund_value_in_usd"),
        F.col("ecommerce.shipping_value_in_usd"),
        F.col("ecommerce.tax_value_in_usd"),
        F.col("ecommerce.total_item_quantity"),
        F.col("ecommerce.unique_items"),
    ]
    return bought.select(*columns, *(["items"] if "items" in raw.columns else []))


def deduped_purchases(raw: DataFrame, start=None, end=None) -> DataFrame:
    """One row per transaction: its earliest purchase event.

    The smallest struct wins, so all fields come from the same event and the
    pick is the same on every run; duplicates are dropped on the map side.
    """
    purchases = raw_purchases(raw, start, end)
    rest = [c for c in purchases.columns if c != "order_key"]
    first = purchases.groupBy("order_key").agg(F.min(F.struct(*rest)).alias("first"))
    return first.select("order_key", "first.*")


def _join_session_dims(df: DataFrame, sessions: DataFrame, dims) -> DataFrame:
    """Left join on the session key that keeps rows without one evenly spread.

    A NULL key matches nothing; giving such rows their own distinct key keeps
    them from gathering in one shuffle partition.
    """
    own_key = F.concat(F.lit("no session "), F.col("order_key"))
    keyed = df.withColumn("join_key", F.coalesce("session_key", own_key))
    right = sessions.select(F.col("session_key").alias("join_key"), *dims)
    return keyed.join(right, "join_key", "left").drop("join_key")


def fct_orders(raw: DataFrame, sessions: DataFrame, start=None, end=None) -> DataFrame:
    """One row per transaction with net revenue and the session's dimensions."""
    orders = _join_session_dims(deduped_purchases(raw, start, end).drop("items"), sessions, ORDER_DIMS)
    refund = F.coalesce("refund_value_in_usd", F.lit(0.0))
    return orders.select(
        "order_key", "session_key", "user_pseudo_id", F.col("user_pseudo_id").alias("buyer_user_id"),
        "event_date", "order_ts",
        F.coalesce("channel_group", F.lit("Other")).alias("channel_group"),
        *[c for c in ORDER_DIMS if c != "channel_group"],
        "gross_revenue",
        refund.alias("refund_value_in_usd"),
        (money("gross_revenue") - money(refund)).cast("double").alias("net_revenue"),
        F.coalesce("shipping_value_in_usd", F.lit(0.0)).alias("shipping_value_in_usd"),
        F.coalesce("tax_value_in_usd", F.lit(0.0)).alias("tax_value_in_usd"),
        "total_item_quantity", "unique_items",
    )


def with_order_counts(orders: DataFrame) -> DataFrame:
    """Adds the buyer's number of orders: counted, then joined back.

    A window over the buyer would gather all orders of one buyer in one task;
    the counts combine on the map side, and adaptive execution can split the
    orders of a hot buyer in the join. An order without a buyer stands alone.
    """
    counts = orders.groupBy("buyer_user_id").agg(F.count(F.lit(1)).alias("user_order_count"))
    joined = orders.join(counts, "buyer_user_id", "left")
    return joined.withColumn("user_order_count", F.coalesce("user_order_count", F.lit(1).cast("long")))


def order_line_key():
    return F.md5(F.concat_ws("-", "order_key", F.coalesce("item_id", F.lit("")), F.col("line_number").cast("string")))


def fct_order_items(raw: DataFrame, sessions: DataFrame, start=None, end=None) -> DataFrame:
    """One row per order line, from the event that ``fct_orders`` keeps."""
    dims = ("channel_group", "device_category", "country")
    orders = _join_session_dims(deduped_purchases(raw, start, end), sessions, dims)
    lines = orders.select(
        "order_key", "session_key", "event_date",
        F.coalesce("channel_group", F.lit("Other")).alias("channel_group"), "device_category", "country",
        F.posexplode("items").alias("position", "item"),
    )
    flat = lines.select(
        "order_key", "session_key", "event_date", "channel_group", "device_category", "country",
        (F.col("position") + 1).alias("line_number"), "item.*",
    )
    return flat.select(order_line_key().alias("order_item_key"), "*")


def item_view_lines(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per session and viewed item, with the session's dimensions.

    Repeated views of an item in a session are counted in ``views`` before the
    join, so the join sees each (session, item) once. Views without a session
    are counted per item and day, in channel Other, as orders are.
    """
    views = (
        raw.filter(F.col("event_name") == "view_item")
        .select(
            session_key("user_pseudo_id", event_param("ga_session_id", "int")).alias("session_key"),
            F.to_date(F.timestamp_micros("event_timestamp")).alias("view_date"),
            F.explode("items").alias("item"),
        )
        .withColumn("lone_date", F.when(F.col("session_key").isNull(), F.col("view_date")))
        .groupBy("session_key", "lone_date", "item.item_id", "item.item_name", "item.item_brand", "item.item_category")
        .agg(F.count(F.lit(1)).alias("views"), F.min("view_date").alias("view_date"))
    )
    # a key of their own spreads the rows without a session over the join
    own_key = F.concat_ws(" ", F.lit("no session"), "lone_date", "item_id")
    keyed = views.withColumn("join_key", F.coalesce("session_key", own_key))
    dims = sessions.select(F.col("session_key").alias("join_key"), "event_date", "channel_group", "device_category", "country")
    joined = keyed.join(dims, "join_key", "left").withColumns({
        "event_date": F.coalesce("event_date", "view_date"), "channel_group": F.coalesce("channel_group", F.lit("Other")),
        "item_viewed_in_session": F.lit(True),
    })
    return joined.select(
        "session_key", "item_id", "item_name", "item_brand", "item_category", "views", "event_date", "channel_group", "device_category",
        "country", "item_viewed_in_session",
    )


def item_lines(order_items: DataFrame, view_lines: DataFrame) -> DataFrame:
    """View and purchase lines in one table, told apart by 0/1 counts."""
    dims = ["session_key", "event_date", "channel_group", "device_category", "country", "item_id", "item_name", "item_brand", "item_category"]
    bought = order_items.select(
        *dims, "order_key", F.lit(True).alias("item_in_order"), "item_revenue_in_usd",
        F.lit(0).cast("long").alias("item_views"), F.lit(1).cast("long").alias("item_purchases"),
    )
    viewed = view_lines.select(
        *dims, F.lit(None).cast("string").alias("order_key"), F.lit(False).alias("item_in_order"),
        F.lit(None).cast("double").alias("item_revenue_in_usd"),
        F.col("views").alias("item_views"), F.lit(0).cast("long").alias("item_purchases"),
    )
    return bought.unionByName(viewed)
