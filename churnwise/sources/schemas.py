"""Explicit schemas of the logical tables (no schema inference)."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# raw CSV layouts: dates arrive as text and are parsed in the cleaning step
ORDERS_CSV = _st(("order_id", S), ("customer_id", S), ("order_status", S),
                 ("order_purchase_timestamp", S), ("order_approved_at", S),
                 ("order_delivered_carrier_date", S), ("order_delivered_customer_date", S),
                 ("order_estimated_delivery_date", S))
ITEMS_CSV = _st(("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
                ("shipping_limit_date", S), ("price", D), ("freight_value", D))
PAYMENTS_CSV = _st(("order_id", S), ("payment_sequential", I), ("payment_type", S),
                   ("payment_installments", I), ("payment_value", D))
REVIEWS_CSV = _st(("review_id", S), ("order_id", S), ("review_score", D),
                  ("review_comment_title", S), ("review_comment_message", S),
                  ("review_creation_date", S), ("review_answer_timestamp", S))
CUSTOMERS_CSV = _st(("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", S),
                    ("customer_city", S), ("customer_state", S))
PRODUCTS_CSV = _st(("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
                   ("product_description_lenght", I), ("product_photos_qty", I),
                   ("product_weight_g", D), ("product_length_cm", D), ("product_height_cm", D),
                   ("product_width_cm", D))

# the order event posted by a live feed (one JSON object per order)
ORDER_EVENT = _st(("order_id", S), ("customer_id", S), ("total_value", D),
                  ("order_timestamp", TS), ("review_score", D))

DATE_COLUMNS = ("order_purchase_timestamp", "order_delivered_customer_date",
                "order_estimated_delivery_date")

# file names of the six order tables inside a data folder
ORDER_FILES = {
    "orders": ("olist_orders_dataset.csv", ORDERS_CSV),
    "items": ("olist_order_items_dataset.csv", ITEMS_CSV),
    "payments": ("olist_order_payments_dataset.csv", PAYMENTS_CSV),
    "reviews": ("olist_order_reviews_dataset.csv", REVIEWS_CSV),
    "customers": ("olist_customers_dataset.csv", CUSTOMERS_CSV),
    "products": ("olist_products_dataset.csv", PRODUCTS_CSV),
}
