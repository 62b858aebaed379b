"""Report and export queries over the scored customer table (R7-R16 parts).

Each takes the scored customer frame (features plus segment, probability,
action, predicted value, tier) and returns a DataFrame.  Lists that the
serving side caps are ``orderBy(...).limit(n)`` (a top-k, planned as
TakeOrderedAndProject: each task keeps n rows, nothing is sorted globally).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnwise import config
from churnwise.functions.scalar import mean_exact, money, round_half_even
from churnwise.operators.ranking import exact_quantiles

CUST = "customer_unique_id"
LIST_COLS = ("customer_unique_id", "segment", "recency", "frequency", "monetary",
             "avg_review_score", "churn_probability", "action")
EXPORT_ACTION_COLS = ("customer_unique_id", "segment", "churn_probability", "monetary",
                      "recency", "frequency", "avg_review_score", "action")
EXPORT_CUSTOMER_COLS = ("customer_unique_id", "segment", "churned", "churn_prediction",
                        "churn_probability", "action", "predicted_clv", "clv_tier", "monetary",
                        "frequency", "recency", "avg_review_score", "avg_delivery_delay")
TOP_CLV_COLS = ("customer_unique_id", "predicted_clv", "clv_tier", "segment",
                "churn_probability", "monetary", "frequency", "action")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def share_of_total(df: DataFrame, col: str) -> DataFrame:
    """Count and share of all rows per value (pie data)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return value_counts(df, col).withColumn("share", F.col("count") / total)


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """Customers, revenue, mean of per-customer order value, churn %."""
    return df.agg(F.count(F.lit(1)).alias("total_customers"),
                  round_half_even(F.sum(money("monetary")).cast("double"), 2).alias("total_revenue"),
                  round_half_even(mean_exact("avg_order_value"), 2).alias("avg_order_value"),
                  round_half_even(F.avg("churned") * 100, 1).alias("churn_rate"))


def clv_stats(df: DataFrame, buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """Mean, median and total predicted value."""
    med = exact_quantiles(df, "predicted_clv", [0.5], ["median_clv"], buckets=buckets)
    tot = df.agg(round_half_even(mean_exact("predicted_clv"), 2).alias("mean_clv"),
                 round_half_even(F.sum(money("predicted_clv")).cast("double"), 2)
                 .alias("total_predicted_value"))
    return tot.select("mean_clv", round_half_even(med.select("median_clv").scalar(), 2).alias("median_clv"),
                      "total_predicted_value")


def rfm_box_stats(df: DataFrame, metrics: Sequence[str] = ("recency", "frequency", "monetary"),
                  buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """Min, quartiles and max of R, F, M per segment (box-plot data)."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in metrics]))
    long = df.select("segment", stack.alias("s")).select("segment", "s.metric", "s.value")
    return exact_quantiles(long, "value", [0.0, 0.25, 0.5, 0.75, 1.0],
                           ["min", "q1", "median", "q3", "max"], group_cols=["segment", "metric"],
                           buckets=buckets)


def quadrant_lines(df: DataFrame, buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """The median (vertical divider) and 95th percentile (axis end) of monetary."""
    return exact_quantiles(df, "monetary", [0.5, 0.95], ["monetary_median", "monetary_p95"],
                           buckets=buckets)


def top_by(df: DataFrame, col: str, n: int, cols: Sequence[str]) -> DataFrame:
    """The n largest by ``col``, ties by customer id."""
    return df.orderBy(F.col(col).desc(), F.col(CUST)).limit(n).select(*cols)


def top_clv(df: DataFrame, n: int = config.TOP_CLV_SERVED) -> DataFrame:
    return top_by(df, "predicted_clv", n, TOP_CLV_COLS)


def segment_drilldown(df: DataFrame, segment: str = "All", n: int = config.DRILLDOWN_LIMIT) -> DataFrame:
    """F17 + L2: one segment (or all), top n by monetary."""
    d = df if segment == "All" else df.filter(F.col("segment") == segment)
    return top_by(d, "monetary", n, LIST_COLS)


def customer_list(df: DataFrame, n: int | None = None) -> DataFrame:
    """L4: all customers with the list columns; with ``n`` the first n in id order."""
    if n is not None:
        df = df.orderBy(CUST).limit(n)
    return df.select(*LIST_COLS)


def scatter_points(df: DataFrame, per_action: int | None = None) -> DataFrame:
    """L4 + W6 + F18: every customer as a point (value, risk) with its full id.

    ``per_action`` keeps the customers of lowest id hash in each action, taken
    over the whole table: each task keeps its own first ones, so no action is
    gathered in one task."""
    points = df.select("action", F.col("monetary").alias("x"), F.col("churn_probability").alias("y"),
                       F.col(CUST).alias("id"), "segment")
    if per_action is None:
        return points
    h = F.xxhash64("id")
    w = Window.partitionBy("action").orderBy(h, "id")
    wt = Window.partitionBy("action", "_t").orderBy(h, "id")
    local = (points.withColumn("_t", F.pmod(h, F.lit(config.RANK_BUCKETS))).withColumn("_rn", F.row_number().over(wt))
             .filter(F.col("_rn") <= per_action).drop("_rn", "_t"))
    return local.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_action).drop("_rn")


def export_action(df: DataFrame, action_key: str) -> DataFrame:
    """F15 + L7: customers of one action, highest probability first."""
    key = action_key.upper()
    if key not in config.ACTIONS:
        raise ValueError(f"Invalid action. Valid: {list(config.ACTIONS)}")
    return (df.filter(F.col("action") == key).select(*EXPORT_ACTION_COLS)
            .orderBy(F.col("churn_probability").desc(), F.col(CUST)))


def export_customers(df: DataFrame, status: str = "ALL", segment: str = "ALL") -> DataFrame:
    """F13 + F14 + F16 + L7: filter by predicted status and segment (any
    case; unknown status = no filter), keep the export columns present."""
    s = (status or "ALL").upper()
    if s == "CHURNED":
        df = df.filter(F.col("churn_prediction") == 1)
    elif s == "RETAINED":
        df = df.filter(F.col("churn_prediction") == 0)
    if (segment or "ALL").upper() != "ALL":
        df = df.filter(F.upper(F.col("segment")) == segment.upper())
    cols = [c for c in EXPORT_CUSTOMER_COLS if c in df.columns]
    return df.select(*cols).orderBy(F.col("churn_probability").desc(), F.col(CUST))


def column_stats(df: DataFrame, buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """Count, mean, sample deviation, minimum, interpolated quartiles and maximum of every column, exact.

    Sums and squares are exact decimals of six places (squares of 10^12 and above are doubles), so they do not depend on row
    order; places beyond the sixth are rounded."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                         for c in df.columns])).alias("s")).select("s.column", "s.value")
    small = F.abs("value") < 1e12
    v = F.when(small, F.col("value")).cast("decimal(18,6)")
    large = F.coalesce(F.sum(F.when(~small, F.col("value") * F.col("value"))), F.lit(0.0))
    sums = long.groupBy("column").agg(F.count("value").alias("count"), F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("_s"),
                                      (F.coalesce(F.sum((v * v).cast("decimal(38,12)")).cast("double"), F.lit(0.0)) + large).alias("_ss"))
    n, s, ss = F.col("count"), F.col("_s"), F.col("_ss")
    sums = sums.select("column", "count", round_half_even(s / n, 4).alias("mean"),
                       round_half_even(F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1)), 3).alias("std"))
    q = exact_quantiles(long, "value", [0.0, 0.25, 0.5, 0.75, 1.0], ["min", "q1", "median", "q3", "max"],
                        group_cols=["column"], buckets=buckets)
    return sums.join(q.select("column", *[round_half_even(c, 4).alias(c) for c in ("min", "q1", "median", "q3", "max")]), "column")


def descriptions(df: DataFrame) -> DataFrame:
    """Every segment and action with its description and its number of customers."""
    def of(kind, texts):
        frame = df.sparkSession.createDataFrame([(kind, k, v) for k, v in texts.items()], "kind string, name string, description string")
        return frame.join(value_counts(df, kind).select(F.col(kind).alias("name"), F.col("count").alias("customers")), "name", "left")
    both = of("segment", config.SEGMENT_DESCRIPTIONS).unionByName(of("action", config.ACTION_DESCRIPTIONS))
    return both.select("kind", "name", "description", F.coalesce("customers", F.lit(0)).alias("customers"))
