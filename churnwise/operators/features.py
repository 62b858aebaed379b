"""Customer features with a time-based label split.

The reference computes the feature window and the target window as two
frames, aggregates each per customer and left-joins them.  Here both windows
come out of one two-level aggregation:

* level 1 groups by (customer, order, window flag): its shuffle spreads
  evenly even when one customer holds a third of all orders, and it makes
  "distinct orders per window" a plain count (no Expand of the rows for
  two conditional distinct aggregates);
* level 2 groups by customer with conditional sums; partial aggregation
  runs map-side, so the hot customer is one row per map task before its
  (small) shuffle.

Result: two shuffles, the second of pre-aggregated rows, where the direct
form needs two skew-prone distinct aggregates plus a join; the two windows
are disjoint and complete by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise import config
from churnwise.functions.scalar import add_days, day_diff, money, round_half_even

TS = "order_purchase_timestamp"
CUST = "customer_unique_id"


def cutoff_of(clean: DataFrame, horizon_days: int = config.HORIZON_DAYS) -> Column:
    """A10 + C1: (last purchase + 1 day) - horizon, as a scalar subquery."""
    last = clean.agg(F.max(TS).alias("m")).scalar()
    return add_days(add_days(last, 1), -horizon_days)


def split_by_cutoff(clean: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """F8: feature window (before the cutoff) and target window (from it)."""
    return clean.filter(F.col(TS) < cutoff), clean.filter(F.col(TS) >= cutoff)


def time_split_counts(clean: DataFrame, horizon_days: int = config.HORIZON_DAYS) -> DataFrame:
    """Row and customer counts on each side of the cutoff (a one-row audit)."""
    cutoff = cutoff_of(clean, horizon_days)
    feat = F.col(TS) < cutoff
    tgt = F.col(TS) >= cutoff
    return clean.agg(
        F.max(cutoff).alias("cutoff_date"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(feat).alias("n_feature_rows"),
        F.count_if(tgt).alias("n_target_rows"),
        F.count_if(F.col(TS).isNull()).alias("n_undated_rows"),
        F.count_distinct(F.when(feat, F.col(CUST))).alias("n_feature_customers"),
        F.count_distinct(F.when(tgt, F.col(CUST))).alias("n_target_customers"))


def _order_level(clean: DataFrame, cutoff: Column) -> DataFrame:
    w = (F.when(F.col(TS) < cutoff, F.lit(1))
         .when(F.col(TS) >= cutoff, F.lit(2)))          # null date: in neither window
    return (clean.withColumn("_w", w).filter(F.col("_w").isNotNull())
            .groupBy(CUST, "order_id", "_w")
            .agg(F.count(F.lit(1)).alias("_rows"),
                 F.sum(money("total_payment")).alias("_pay"),
                 F.count("total_payment").alias("_pay_n"),
                 F.sum("review_score").alias("_rev"),
                 F.count("review_score").alias("_rev_n"),
                 F.sum("n_items").alias("_items"),
                 F.sum("n_unique_categories").alias("_cats"),
                 F.sum("delivery_delay_days").alias("_delay"),
                 F.count("delivery_delay_days").alias("_delay_n"),
                 F.min(TS).alias("_first"),
                 F.max(TS).alias("_last")))


def customer_features(clean: DataFrame, horizon_days: int = config.HORIZON_DAYS,
                      with_labels: bool = True) -> DataFrame:
    """A6-A9 + J7 + F11: one row per customer with at least one order in the
    feature window; target columns are 0 for customers absent from the
    target window (churned = 1)."""
    cutoff = cutoff_of(clean, horizon_days)
    lvl = _order_level(clean, cutoff)
    f = F.col("_w") == 1
    t = F.col("_w") == 2

    def fsum(c):
        return F.sum(F.when(f, F.col(c)))

    agg = lvl.groupBy(CUST).agg(
        F.sum(F.when(f, F.col("_rows"))).alias("_n_feat"),
        F.count(F.when(f, F.col("order_id"))).alias("frequency"),
        fsum("_pay").alias("_monetary"),
        fsum("_pay_n").alias("_pay_n"),
        fsum("_rev").alias("_rev"),
        fsum("_rev_n").alias("_rev_n"),
        fsum("_items").alias("total_items"),
        fsum("_cats").alias("unique_categories"),
        fsum("_delay").alias("_delay"),
        fsum("_delay_n").alias("_delay_n"),
        F.min(F.when(f, F.col("_first"))).alias("_first"),
        F.max(F.when(f, F.col("_last"))).alias("_last"),
        F.count(F.when(t, F.col("order_id"))).alias("_t_orders"),
        F.sum(F.when(t, F.col("_pay"))).alias("_t_revenue"),
    ).filter(F.col("_n_feat") > 0)

    def mean(s, n):
        return F.when(F.col(n) > 0, F.col(s).cast("double") / F.col(n))

    span = day_diff("_last", "_first")
    freq = F.col("frequency")
    cols = [
        F.col(CUST),
        day_diff(cutoff, "_last").alias("recency"),
        freq.cast(T.LongType()).alias("frequency"),
        F.coalesce(F.col("_monetary").cast("double"), F.lit(0.0)).alias("monetary"),
        mean("_monetary", "_pay_n").alias("avg_order_value"),
        mean("_rev", "_rev_n").alias("avg_review_score"),
        F.col("total_items").cast(T.LongType()).alias("total_items"),
        F.col("unique_categories").cast(T.LongType()).alias("unique_categories"),
        mean("_delay", "_delay_n").alias("avg_delivery_delay"),
        span.alias("purchase_span_days"),
        F.when(freq > 1, span / (freq - 1)).otherwise(F.lit(0.0)).alias("avg_days_between_purchases"),
    ]
    if with_labels:
        tp = F.col("_t_orders").cast("double")
        tr = F.coalesce(F.col("_t_revenue").cast("double"), F.lit(0.0))
        cols += [tp.alias("target_purchases"), tr.alias("target_revenue"),
                 (tp == 0).cast(T.IntegerType()).alias("churned"), tr.alias("clv_target")]
    out = agg.select(*cols)
    return round_numeric(out)


def round_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    """every floating column rounded half-to-even (integers unchanged)."""
    return df.select(*[round_half_even(c, digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def target_outcomes(clean: DataFrame, horizon_days: int = config.HORIZON_DAYS) -> DataFrame:
    """Orders and revenue per customer inside the target window."""
    cutoff = cutoff_of(clean, horizon_days)
    _, tgt = split_by_cutoff(clean, cutoff)
    return (tgt.groupBy(CUST)
            .agg(F.count_distinct("order_id").cast("double").alias("target_purchases"),
                 F.coalesce(F.sum(money("total_payment")).cast("double"), F.lit(0.0)).alias("target_revenue")))
