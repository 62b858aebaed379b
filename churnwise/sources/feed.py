"""Flat order feed (S3, F19, L9) and its JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.functions.scalar import money_sum, parse_ts
from churnwise.operators.orders import first_review
from churnwise.sources.tables import OrderTables


def order_feed(t: OrderTables, limit: int | None = None) -> DataFrame:
    """Delivered orders as order events: person id, item price total, first
    review, purchase time.  With ``limit`` the earliest orders only (L9)."""
    o = t.orders.filter(F.col("order_status") == "delivered")                        # F1
    o = o.join(t.customers.select("customer_id", "customer_unique_id"), "customer_id", "left")  # J1
    totals = (t.items.filter(F.col("order_id").isNotNull()).groupBy("order_id")
              .agg(F.coalesce(money_sum("price"), F.lit(0.0)).alias("total_value")))   # A4
    o = o.join(totals, "order_id", "left").join(first_review(t.reviews), "order_id", "left")  # J4, J3
    o = o.dropna(subset=["total_value", "order_purchase_timestamp"])                 # F2
    ts = F.col("order_purchase_timestamp")
    if dict(o.dtypes)["order_purchase_timestamp"] == "string":
        ts = parse_ts(ts)
    feed = o.select("order_id", F.col("customer_unique_id").alias("customer_id"), "total_value",  # F19
                    ts.alias("order_timestamp"), "review_score")
    if limit:
        feed = feed.orderBy("order_timestamp", "order_id").limit(limit)
    return feed


def to_payload(feed: DataFrame) -> DataFrame:
    """One JSON object per order; a missing review is left out."""
    ts = F.date_format("order_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return feed.select(F.to_json(F.struct("order_id", "customer_id", "total_value",
                                          ts.alias("order_timestamp"), "review_score")).alias("value"))
