"""Serving views (R7-R16): each endpoint response as DataFrames over the stored result tables.

``results`` is the dict returned (and written) by :func:`churnwise.plans.models.run_all`,
or the same tables read back from its output folder with :func:`read_results`.
One-row responses are assembled from scalar subqueries, never from joins of
one-row frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise import config
from churnwise.operators import actions, histogram, reports
from churnwise.session import path_exists

TABLES = ("customers", "segment_summary", "k_sweep", "churn_metrics", "confusion", "classification_report",
          "error_analysis", "baselines", "feature_importance", "top_reasons", "clv_metrics", "clv_thresholds",
          "activation_events", "activation_summary", "status")


def read_results(spark: SparkSession, out_dir: str) -> dict:
    """The stored tables of a run, from any store that Spark reads."""
    base = out_dir.rstrip("/")
    return {t: spark.read.parquet(f"{base}/{t}") for t in TABLES if path_exists(spark, f"{base}/{t}")}


def one_row(base: DataFrame, *frames: DataFrame) -> DataFrame:
    """``base`` (one row) widened with the columns of other one-row frames, one subquery per frame."""
    names = [f"_f{i}" for i in range(len(frames))]
    wide = base.select("*", *[f.select(F.struct(*f.columns)).scalar().alias(x) for f, x in zip(frames, names)])
    return wide.select(*base.columns, *[F.col(f"{x}.{c}").alias(c) for f, x in zip(frames, names) for c in f.columns])


def dashboard_stats(customers: DataFrame, churn_metrics: DataFrame, clv_metrics: DataFrame, as_of=None) -> DataFrame:
    """KPIs, churn model metrics, value statistics and value model metrics in one row, with the run's time."""
    row = one_row(reports.dashboard_kpis(customers), churn_metrics, reports.clv_stats(customers), clv_metrics)
    return row if as_of is None else row.withColumn("last_trained", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss"))


def total_customers(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count(F.lit(1)).alias("total_customers"))


def segments_view(results: dict, n: int | None = None) -> dict:
    """Summary, distribution, customers (all, or the first ``n``), number of customers."""
    c = results["customers"]
    return {"segment_summary": results["segment_summary"], "segment_distribution": reports.value_counts(c, "segment"),
            "customers": reports.customer_list(c, n), "total_customers": total_customers(c)}


def explained_customers(customers: DataFrame, reasons: DataFrame, n: int | None = None) -> DataFrame:
    """L6 + J10: the explained customers with all their reasons; with ``n`` the n of highest risk (ties by id)."""
    c = customers.select("customer_unique_id", "segment", "monetary", "churn_score")
    if n is not None:
        c = c.orderBy(F.col("churn_score").desc(), "customer_unique_id").limit(n)
    return reasons.join(c.drop("churn_score"), "customer_unique_id")


def churn_risk_view(results: dict, n: int = config.TOP_EXPLAINED_SERVED) -> dict:
    """Metrics + confusion, importance, the ``n`` riskiest customers explained, probability histogram."""
    return {"metrics": one_row(results["churn_metrics"], results["confusion"]),
            "feature_importance": results["feature_importance"],
            "top_high_risk_users": explained_customers(results["customers"], results["top_reasons"], n),
            "churn_distribution": histogram.histogram(results["customers"], "churn_probability")}


def action_matrix_view(results: dict) -> dict:
    """Action distribution, scatter points, number of customers."""
    c = results["customers"]
    return {"action_distribution": reports.value_counts(c, "action"), "scatter_data": reports.scatter_points(c),
            "total_customers": total_customers(c)}


def clv_view(results: dict) -> dict:
    """Value metrics, thresholds, tier distribution, top customers, total."""
    c = results["customers"]
    return {"clv_metrics": results["clv_metrics"], "clv_thresholds": results["clv_thresholds"],
            "tier_distribution": reports.value_counts(c, "clv_tier"), "top_customers": reports.top_clv(c),
            "total_predicted_value": reports.clv_stats(c).select("total_predicted_value")}


def activations_view(results: dict) -> dict:
    """Activation summary and the most recent events."""
    return {"summary": results["activation_summary"],
            "recent_events": actions.recent_activations(results["activation_events"])}
