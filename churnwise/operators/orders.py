"""Order-level merge and cleaning.

Every child table is aggregated to one row per order *before* it is joined,
so the left joins never fan out; the aggregates are hash-partitioned on
``order_id`` by their own shuffle, and the order-side joins reuse that.
Null grouping keys are dropped first (a pandas ``groupby`` drops them,
Spark would keep a null group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise import config
from churnwise.functions.scalar import day_diff, money_sum, parse_ts
from churnwise.operators.ranking import exact_quantile_value
from churnwise.sources.schemas import DATE_COLUMNS
from churnwise.sources.tables import OrderTables


def _keyed(df: DataFrame, key: str = "order_id") -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def payments_per_order(payments: DataFrame) -> DataFrame:
    """A1: total payment per order (an order may have several payment rows)."""
    return (_keyed(payments).groupBy("order_id")
            .agg(F.coalesce(money_sum("payment_value"), F.lit(0.0)).alias("total_payment")))


def items_per_order(items: DataFrame) -> DataFrame:
    """A2: number of item rows (non-null item id) and freight per order."""
    return (_keyed(items).groupBy("order_id")
            .agg(F.count("order_item_id").alias("n_items"),
                 F.coalesce(money_sum("freight_value"), F.lit(0.0)).alias("total_freight")))


def items_with_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items left-joined to the product category (products pruned to two columns)."""
    return items.join(products.select("product_id", "product_category_name"), "product_id", "left")


def categories_per_order(items: DataFrame, products: DataFrame) -> DataFrame:
    """A3: distinct non-null categories per order (0 when all are null)."""
    return (_keyed(items_with_category(items, products)).groupBy("order_id")
            .agg(F.count_distinct("product_category_name").alias("n_unique_categories")))


def items_summary(items: DataFrame, products: DataFrame) -> DataFrame:
    """A2 and A3 in one aggregation, so the item table is shuffled once."""
    return (_keyed(items_with_category(items, products)).groupBy("order_id")
            .agg(F.count("order_item_id").alias("n_items"),
                 F.coalesce(money_sum("freight_value"), F.lit(0.0)).alias("total_freight"),
                 F.count_distinct("product_category_name").alias("n_unique_categories")))


def _review_order_key():
    # latest date wins; a missing date sorts after every date (pandas puts NaT
    # last and keeps the last row); on equal dates the higher score wins and a
    # missing score loses.  Deterministic, unlike an unstable sort.
    d = F.col("review_creation_date")
    return F.struct(d.isNull().alias("a"), d.alias("b"), F.col("review_score").alias("c"))


def latest_review(reviews: DataFrame) -> DataFrame:
    """The review of each order with the latest creation date.

    Written as ``max(struct(date, score))`` per order instead of a
    ``row_number`` window: the max is partially aggregated map-side, so an
    order with very many reviews does not land whole in one task.
    """
    return (_keyed(reviews).groupBy("order_id")
            .agg(F.max(_review_order_key()).getField("c").alias("review_score")))


def first_review(reviews: DataFrame) -> DataFrame:
    """A5: first non-null review score per order, first = earliest date
    (lowest score on equal dates): a deterministic reading of "file order"."""
    r = _keyed(reviews).filter(F.col("review_score").isNotNull())
    key = F.struct(F.col("review_creation_date").isNull().alias("a"),
                   F.col("review_creation_date").alias("b"), F.col("review_score").alias("c"))
    return r.groupBy("order_id").agg(F.min(key).getField("c").alias("review_score"))


def merge_orders(t: OrderTables) -> DataFrame:
    """Orders with person id, payment total, latest review, item
    totals and category count."""
    items = items_summary(t.items, t.products)
    return (t.orders
            .join(t.customers.select("customer_id", "customer_unique_id"), "customer_id", "left")
            .join(payments_per_order(t.payments), "order_id", "left")
            .join(latest_review(t.reviews), "order_id", "left")
            .join(items, "order_id", "left")
            .select("order_id", "customer_id", "order_status", *DATE_COLUMNS,
                    "customer_unique_id", "total_payment", "review_score",
                    "n_items", "total_freight", "n_unique_categories"))


def keep_orders(master: DataFrame) -> DataFrame:
    """Delivered, trackable person, dates parsed, positive payment.

    Filters on order columns sit above the left joins; Catalyst pushes the
    status filter into the order scan, and the not-null / positive filters on
    joined columns turn those left joins into inner joins.
    """
    df = master.filter(F.col("order_status") == "delivered")            # F1
    df = df.filter(F.col("customer_unique_id").isNotNull())             # F2
    types = dict(df.dtypes)
    for c in DATE_COLUMNS:                                               # F3
        if c in types and types[c] == "string":
            df = df.withColumn(c, parse_ts(c))
    return df.filter(F.col("total_payment") > 0)                         # F4


def finish_clean(kept: DataFrame, rank_buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """Median review fill, count / freight fills, delivery delay.

    The median is a global statistic of ``kept``; it enters the plan as a
    scalar subquery, so ``kept`` should be a materialised stage (see
    :func:`churnwise.plans.batch.order_stage`) rather than a long lineage.
    """
    types = dict(kept.dtypes)
    median = exact_quantile_value(kept, "review_score", 0.5, rank_buckets)  # F5
    df = kept.withColumn("review_score", F.coalesce(F.col("review_score"), median))
    df = df.withColumns({                                                # F6
        "n_items": F.coalesce(F.col("n_items"), F.lit(1)).cast(T.IntegerType()),
        "total_freight": F.coalesce(F.col("total_freight"), F.lit(0.0)),
        "n_unique_categories": F.coalesce(F.col("n_unique_categories"), F.lit(1)).cast(T.IntegerType()),
    })
    if "order_delivered_customer_date" in types and "order_estimated_delivery_date" in types:  # F7
        delay = day_diff("order_delivered_customer_date", "order_estimated_delivery_date")
        df = df.withColumn("delivery_delay_days", F.coalesce(delay, F.lit(0)))
    return df


def clean_orders(master: DataFrame, rank_buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """F1-F7 on the merged frame, fully lazy."""
    return finish_clean(keep_orders(master), rank_buckets)
