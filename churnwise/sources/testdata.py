"""Adapter from the driver's TPC-H-like parquet tables to the order tables.

Mapping (all derived by Spark from the given tables, so the work grows with
the scale factor):

* person          = ``customer.c_name``; order customer = ``o_custkey``
* order           = ``orders`` row; delivered = ``o_orderstatus = 'F'``
* delivered date  = latest ``l_shipdate`` of the order; estimate = order date + 30 days
* items           = ``lineitem`` rows; product = ``l_partkey``; price = ``l_extendedprice``;
                    freight = ``l_extendedprice * l_tax`` (exact decimal product)
* payments        = one row per order with ``o_totalprice``
* reviews         = one per ``lineitem`` row, dated ``l_shipdate``; score
                    ``1 + (l_orderkey*31 + l_linenumber) % 5``, missing when
                    ``(l_orderkey + l_linenumber) % 7 = 0``
* category        = ``part.p_type``
* live purchases  = ``events`` with ``event_type = 'purchase'``
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.functions.scalar import add_days
from churnwise.sources.tables import OrderTables

# FIXED VALUES of the adapter (the DuckDB oracle uses the same)
STATUS_MAP = {"F": "delivered", "O": "shipped", "P": "processing"}
ESTIMATE_DAYS = 30


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_test_tables(spark: SparkSession, sf_dir: str) -> OrderTables:
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    c = read_table(spark, sf_dir, "customer")
    p = read_table(spark, sf_dir, "part")

    delivered = (li.groupBy("l_orderkey")
                 .agg(F.max("l_shipdate").alias("order_delivered_customer_date")))
    # one CASE expression; Catalyst folds "status = 'delivered'" into a boolean
    # CASE on o_orderstatus evaluated right after the scan (not a parquet filter)
    status = None
    for k, v in STATUS_MAP.items():
        cond = F.col("o_orderstatus") == k
        status = F.when(cond, F.lit(v)) if status is None else status.when(cond, F.lit(v))
    status = status.otherwise(F.col("o_orderstatus"))
    orders = (o.join(delivered, o.o_orderkey == delivered.l_orderkey, "left")
              .select(F.col("o_orderkey").cast("string").alias("order_id"),
                      F.col("o_custkey").cast("string").alias("customer_id"),
                      status.alias("order_status"),
                      F.col("o_orderdate").alias("order_purchase_timestamp"),
                      F.col("order_delivered_customer_date"),
                      add_days("o_orderdate", ESTIMATE_DAYS).alias("order_estimated_delivery_date")))
    freight = (F.col("l_extendedprice").cast("decimal(15,2)") * F.col("l_tax").cast("decimal(15,2)"))
    items = li.select(F.col("l_orderkey").cast("string").alias("order_id"),
                      F.col("l_linenumber").alias("order_item_id"),
                      F.col("l_partkey").cast("string").alias("product_id"),
                      F.col("l_extendedprice").alias("price"),
                      freight.cast("double").alias("freight_value"))
    payments = o.select(F.col("o_orderkey").cast("string").alias("order_id"),
                        F.col("o_totalprice").alias("payment_value"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    score = F.when((k + n) % 7 == 0, F.lit(None)).otherwise((1 + (k * 31 + n) % 5).cast("double"))
    reviews = li.select(k.cast("string").alias("order_id"), score.alias("review_score"),
                        F.col("l_shipdate").alias("review_creation_date"))
    customers = c.select(F.col("c_custkey").cast("string").alias("customer_id"),
                         F.col("c_name").alias("customer_unique_id"))
    products = p.select(F.col("p_partkey").cast("string").alias("product_id"),
                        F.col("p_type").alias("product_category_name"))
    return OrderTables(orders, items, payments, reviews, customers, products)


def load_purchase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as order payloads (order_id, customer_id, total_value,
    order_timestamp, review_score).  The review comes from the ``k`` field
    of the JSON ``props`` column: ``1 + k % 5``."""
    ev = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return ev.select(F.col("event_id").cast("string").alias("order_id"),
                     F.col("user_id").cast("string").alias("customer_id"),
                     F.col("value").alias("total_value"),
                     F.col("ts").alias("order_timestamp"),
                     (1 + k % 5).cast("double").alias("review_score"))
