"""The six order tables as one bundle, and the CSV readers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.sources import schemas


class OrderTables(NamedTuple):
    orders: DataFrame      # order_id, customer_id, order_status, 3 dates
    items: DataFrame       # order_id, order_item_id, product_id, price, freight_value
    payments: DataFrame    # order_id, payment_value
    reviews: DataFrame     # order_id, review_score, review_creation_date
    customers: DataFrame   # customer_id, customer_unique_id
    products: DataFrame    # product_id, product_category_name


def load_order_tables(spark: SparkSession, data_dir: str) -> OrderTables:
    """Read the six order CSV files with declared schemas.

    Dates stay text here; :func:`churnwise.operators.orders.clean_orders`
    parses them (invalid -> null).  The review date is parsed right away
    because the review de-duplication orders by it.  Review comments hold quoted
    line breaks and doubled quotes, so that file alone is read by record, not by line.
    """
    def rd(key, **options):
        name, st = schemas.ORDER_FILES[key]
        return (spark.read.schema(st).options(header=True, mode="PERMISSIVE", quote='"', escape='"', **options)
                .csv(f"{data_dir.rstrip('/')}/{name}"))

    reviews = rd("reviews", multiLine=True).withColumn("review_creation_date",
                                       F.try_to_timestamp("review_creation_date"))
    return OrderTables(rd("orders"), rd("items"), rd("payments"), reviews,
                       rd("customers"), rd("products"))


def write_order_tables(tables: OrderTables, data_dir: str) -> None:
    """The six tables in the CSV layout that :func:`load_order_tables` reads (each a folder of part files).

    Columns of the layout that a table lacks are empty, timestamps are text to
    the microsecond, quotes are doubled; null is an empty field.
    """
    for key, df in tables._asdict().items():
        name, layout = schemas.ORDER_FILES[key]
        kinds = dict(df.dtypes)

        def field(f):
            if f.name not in kinds:
                return F.lit(None).cast("string").alias(f.name)
            if kinds[f.name].startswith(("timestamp", "date")):
                return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
            return F.col(f.name).cast("string").alias(f.name)
        (df.select(*[field(f) for f in layout.fields]).write.mode("overwrite")
         .options(header=True, quote='"', escape='"').csv(f"{data_dir.rstrip('/')}/{name}"))


def load_uploaded_csv(spark: SparkSession, path: str, customer_col: str, date_col: str,
                      value_col: str, order_col: str | None = None) -> DataFrame:
    """An arbitrary CSV mapped to (customer_id, order_id, order_ts, value).

    The file must hold a customer id, a date and a money column; a missing
    column is an error at plan-build time, not a late job failure.  Without an
    order column the id is a hash of the three values and the row's number among
    equal rows, which are interchangeable: it does not depend on the file layout.
    """
    df = spark.read.option("header", True).csv(path)
    need = [customer_col, date_col, value_col] + ([order_col] if order_col else [])
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"uploaded CSV lacks required columns: {missing}")
    if order_col:
        oid = F.col(order_col)
    else:
        parts = [customer_col, date_col, value_col]
        df = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_copies"))
        df = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        oid = F.sha2(F.to_json(F.struct(*parts, "_copy")), 256)
    return df.select(F.col(customer_col).alias("customer_id"), oid.alias("order_id"),
                     F.try_to_timestamp(F.col(date_col)).alias("order_ts"),
                     F.col(value_col).try_cast("double").alias("value"))
