"""Hand-built frames for each semantic trap (pandas is the brute-force reference)."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnwise.functions.scalar import day_diff, round_half_even
from churnwise.operators import histogram, orders, ranking


def test_day_difference_floors(spark):
    a = dt.datetime(2020, 1, 2, 0, 0)
    df = spark.createDataFrame([(a, a - dt.timedelta(hours=2)), (a, a + dt.timedelta(hours=2)),
                                (a, a + dt.timedelta(days=3, hours=1))], "a timestamp, b timestamp")
    got = [r[0] for r in df.select(day_diff("b", "a")).collect()]
    want = [int((pd.Timestamp(b) - pd.Timestamp(a)).days) for a, b in df.collect()]
    assert got == want == [-1, 0, 3]


def test_round_half_even_matches_numpy(spark):
    vals = [0.125, 0.375, 2.675, 1.005, -0.125, 12345.675, 0.5, 1.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_average_rank_percentile(spark):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate([10, 20, 20, 30, None])],
                               "id int, v double")
    for buckets in (1, 2, 64):
        out = {r.id: r.p for r in ranking.avg_rank_pct(df, "v", "p", buckets=buckets).collect()}
        s = pd.Series([10, 20, 20, 30, None], dtype=float).rank(pct=True)
        assert [out[i] for i in range(4)] == list(s[:4]) == [0.25, 0.625, 0.625, 1.0]
        assert out[4] is None


def test_average_rank_hot_value(spark):
    # one value holds a third of all rows
    vals = [7.0] * 300 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v double")
    out = ranking.avg_rank_pct(df, "v", "p", buckets=16).orderBy("id").select("p").toPandas()["p"]
    want = pd.Series(vals).rank(pct=True)
    assert np.allclose(out.to_numpy(), want.to_numpy(), rtol=0, atol=1e-15)


def test_exact_quantiles_grouped(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in "abc" for v in np.round(rng.normal(100, 30, 101 if g != "c" else 2), 2)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0, 0.25, 0.5, 0.75, 0.95, 1]
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))]
           for r in ranking.exact_quantiles(df, "v", probs, group_cols=["g"], buckets=8).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, sub in pdf.groupby("g"):
        assert np.allclose(got[g], np.percentile(sub.v, [p * 100 for p in probs]), rtol=1e-12)


@pytest.mark.parametrize("vals", [[0.0, 0.02, 0.5, 0.51, 1.0, 0.999, 0.3333],
                                  [0.4, 0.4, 0.4], [0.1234, 0.9876, 0.5, 0.5, 0.02]])
def test_histogram_matches_pandas_cut(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = histogram.histogram(df, "p", bins=50).orderBy("bin_index").toPandas()
    vc = pd.Series(vals).value_counts(bins=50, sort=False)
    assert list(got["count"]) == list(vc.values)
    assert list(got["bin"]) == [float(np.round(iv.mid, 2)) for iv in vc.index]


def test_latest_review_and_fills(spark):
    ts = dt.datetime(2020, 1, 1)
    reviews = spark.createDataFrame(
        [("o1", 1.0, ts), ("o1", 5.0, ts + dt.timedelta(days=1)), ("o2", None, ts), ("o2", 3.0, ts),
         ("o3", 4.0, ts), ("o3", 2.0, None)], "order_id string, review_score double, review_creation_date timestamp")
    got = {r.order_id: r.review_score for r in orders.latest_review(reviews).collect()}
    # latest date wins, equal dates prefer a present higher score, a missing date sorts last
    assert got == {"o1": 5.0, "o2": 3.0, "o3": 2.0}
    first = {r.order_id: r.review_score for r in orders.first_review(reviews).collect()}
    assert first == {"o1": 1.0, "o2": 3.0, "o3": 4.0}


def test_category_count_zero_is_not_missing(spark):
    items = spark.createDataFrame([("o1", 1, "p1", 10.0, 1.0), ("o1", 2, "p2", 5.0, None)],
                                  "order_id string, order_item_id int, product_id string, price double, "
                                  "freight_value double")
    products = spark.createDataFrame([("p1", None), ("p2", None)], "product_id string, product_category_name string")
    r = orders.items_summary(items, products).collect()[0]
    assert (r.n_items, r.total_freight, r.n_unique_categories) == (2, 1.0, 0)


def test_column_stats_of_fine_values(spark):
    import numpy as np
    from churnwise.operators import reports
    fine = [0.00123, 0.00456, 1.23456, -7.00001, 0.00009]
    wide = [2e13, 3e13, 1.5, -4e12, 0.25]
    df = spark.createDataFrame(list(zip(fine, wide)), "fine double, wide double")
    got = {r["column"]: r for r in reports.column_stats(df).collect()}
    assert got["fine"]["mean"] == round(float(np.mean(fine)), 4) and got["fine"]["std"] == round(float(np.std(fine, ddof=1)), 3)
    assert abs(got["wide"]["mean"] / np.mean(wide) - 1) < 1e-12 and abs(got["wide"]["std"] / np.std(wide, ddof=1) - 1) < 1e-9
