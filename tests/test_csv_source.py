"""The CSV reader (S1) with text dates (F3) gives the same features as the parquet adapter."""
import os

from pyspark.sql import functions as F

from datadirs import SF001
from churnwise.plans import batch
from churnwise.sources import schemas
from churnwise.sources.tables import load_order_tables
from churnwise.sources.testdata import load_test_tables


def _as_text(df):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c)
                       for c, t in df.dtypes])


def test_csv_tables_give_same_features(spark, tmp_path):
    t = load_test_tables(spark, SF001)
    frames = {"orders": t.orders, "items": t.items, "payments": t.payments, "reviews": t.reviews,
              "customers": t.customers, "products": t.products}
    for key, df in frames.items():
        name, st = schemas.ORDER_FILES[key]
        cols = [F.col(f.name) if f.name in df.columns else F.lit(None).cast("string").alias(f.name) for f in st.fields]
        out = _as_text(df).select(*cols)
        out.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv" / key))
        part = [f for f in os.listdir(tmp_path / "csv" / key) if f.endswith(".csv")][0]
        os.rename(tmp_path / "csv" / key / part, tmp_path / name)
    csv = load_order_tables(spark, str(tmp_path))
    got = batch.run_data(csv).toPandas().set_index("customer_unique_id").sort_index()
    want = batch.run_data(t).toPandas().set_index("customer_unique_id").sort_index()
    assert got.shape == want.shape
    assert (got == want).all().all()


def test_review_comments_with_quoted_line_breaks(spark, tmp_path):
    for name, st in schemas.ORDER_FILES.values():
        (tmp_path / name).write_text(",".join(f.name for f in st.fields) + "\n")
    name, st = schemas.ORDER_FILES["reviews"]
    values = {"order_id": "o1", "review_score": "4", "review_creation_date": "2020-01-02 00:00:00"}
    text = '"said ""good"",\nand came\n\nback"'
    row = ",".join(values.get(f.name, text) for f in st.fields)
    (tmp_path / name).write_text(",".join(f.name for f in st.fields) + "\n" + row + "\n" + row.replace("o1", "o2") + "\n")
    rows = sorted(load_order_tables(spark, str(tmp_path)).reviews.select("order_id", "review_score").collect())
    assert [(r.order_id, r.review_score) for r in rows] == [("o1", 4.0), ("o2", 4.0)]
