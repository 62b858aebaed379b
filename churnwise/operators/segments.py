"""Segment naming and summaries (A11, A12, W3, W4, J8) plus the rule-based segment.

The K-Means stages that produce ``cluster`` live in :mod:`churnwise.operators.ml`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnwise import config
from churnwise.functions.scalar import mean_exact, round_half_even


def rule_segment(pct_col: str = "monetary_percentile"):
    """Deterministic segment from the value percentile quartile (used where a
    checkable stand-in for the clustering is needed)."""
    p = F.col(pct_col)
    names = config.SEGMENT_NAMES
    return (F.when(p > 0.75, names[0]).when(p > 0.5, names[1])
            .when(p > 0.25, names[2]).otherwise(names[3]))


def cluster_summary(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Mean R, F, M and size per cluster."""
    return df.groupBy(cluster_col).agg(
        F.avg("recency").alias("mean_recency"),
        F.avg("frequency").alias("mean_frequency"),
        mean_exact("monetary").alias("mean_monetary"),
        F.count(F.lit(1)).alias("count"))


def _avg_rank(col: str, ascending: bool):
    # pandas rank(method="average") over the k cluster rows: min rank + (ties - 1) / 2
    order = F.col(col).asc() if ascending else F.col(col).desc()
    w = Window.orderBy(order)          # k rows at most: one small partition is fine
    ties = F.count(F.lit(1)).over(Window.partitionBy(col))
    return F.rank().over(w) + (ties - 1) / 2.0


def name_clusters(summary: DataFrame, n_clusters: int = config.N_CLUSTERS,
                  cluster_col: str = "cluster") -> DataFrame:
    """W3 + W4: score = rank(M asc) + rank(F asc) + rank(R desc); the highest
    score is named first.  Ties on score go to the higher mean monetary, then
    the lower cluster id (the source sort is unstable, so the rule is ours)."""
    names = list(config.SEGMENT_NAMES)
    while len(names) < n_clusters:
        names.append(f"Segment-{len(names)}")
    scored = summary.withColumn("score", _avg_rank("mean_monetary", True)
                                + _avg_rank("mean_frequency", True)
                                + _avg_rank("mean_recency", False))
    order = Window.orderBy(F.col("score").desc(), F.col("mean_monetary").desc(), F.col(cluster_col))
    name_arr = F.array(*[F.lit(n) for n in names])
    return scored.withColumn("segment", F.element_at(name_arr, F.row_number().over(order).cast("int")))


def attach_segments(df: DataFrame, named: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Cluster id -> segment name (k rows, broadcast)."""
    return df.join(F.broadcast(named.select(cluster_col, "segment")), cluster_col, "left")


def segment_summary(df: DataFrame) -> DataFrame:
    """A12 + L1: per segment size, mean R/F/M/review (2 places) and churn % (1 place),
    highest mean monetary first."""
    s = df.groupBy("segment").agg(
        F.count("customer_unique_id").alias("customer_count"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        mean_exact("monetary").alias("avg_monetary"),
        mean_exact("avg_review_score").alias("avg_review_score"),
        F.avg("churned").alias("churn_rate"))
    return (s.select("segment", "customer_count",
                     *[round_half_even(c, 2).alias(c) for c in
                       ("avg_recency", "avg_frequency", "avg_monetary", "avg_review_score")],
                     round_half_even(F.col("churn_rate") * 100, 1).alias("churn_rate"))
            .orderBy(F.col("avg_monetary").desc()))
