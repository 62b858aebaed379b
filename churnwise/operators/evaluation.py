"""Model metrics from counts and sums (M10 without AUC, M11, M12, M15, M19).

All classification metrics come from one aggregate of the 2x2 counts, and
the regression metrics from one aggregate of exact decimal sums, so none of
them depends on row order or needs the rows in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise import config

from churnwise.functions.scalar import round_half_even
from churnwise.operators.ranking import exact_quantiles


def confusion_counts(df: DataFrame, label: str = "churned", pred: str = "churn_prediction") -> DataFrame:
    """[[TN, FP], [FN, TP]] as four columns."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def threshold_metrics(df: DataFrame, label: str = "churned", pred: str = "churn_prediction") -> DataFrame:
    """Accuracy, F1, precision, recall of class 1 (0 on zero division), 4 places."""
    c = confusion_counts(df, label, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return c.select(round_half_even(_div(tp + tn, n), 4).alias("accuracy"),
                    round_half_even(_div(2 * tp, 2 * tp + fn + fp), 4).alias("f1_score"),
                    round_half_even(_div(tp, tp + fp), 4).alias("precision"),
                    round_half_even(_div(tp, tp + fn), 4).alias("recall"))


def classification_report(df: DataFrame, label: str = "churned", pred: str = "churn_prediction") -> DataFrame:
    """Precision / recall / F1 / support for class 0, class 1, macro and
    support-weighted averages, plus the accuracy row (4 places)."""
    c = confusion_counts(df, label, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    p0, r0, f0 = _div(tn, tn + fn), _div(tn, tn + fp), _div(2 * tn, 2 * tn + fp + fn)
    p1, r1, f1 = _div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fn + fp)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), round_half_even(p, 4).alias("precision"),
                        round_half_even(r, 4).alias("recall"), round_half_even(f, 4).alias("f1_score"),
                        s.cast("long").alias("support"))
    rows = F.array(row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
                   row("accuracy", _div(tn + tp, n), _div(tn + tp, n), _div(tn + tp, n), n),
                   row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
                   row("weighted avg", _div(p0 * s0 + p1 * s1, n), _div(r0 * s0 + r1 * s1, n),
                       _div(f0 * s0 + f1 * s1, n), n))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def error_analysis(df: DataFrame, label: str = "churned", pred: str = "churn_prediction") -> DataFrame:
    """Missed churners (FN) and false alarms (FP): count, mean recency, mean frequency."""
    y, p = F.col(label), F.col(pred)
    kind = (F.when((y == 1) & (p == 0), "false_negative").when((y == 0) & (p == 1), "false_positive"))
    frame = df.sparkSession.range(1).select(
        F.explode(F.array(F.lit("false_negative"), F.lit("false_positive"))).alias("error_type"))
    agg = (df.withColumn("error_type", kind).filter(F.col("error_type").isNotNull())
           .groupBy("error_type").agg(F.count(F.lit(1)).alias("n"),
                                      F.avg("recency").alias("avg_recency"),
                                      F.avg("frequency").alias("avg_frequency")))
    return (frame.join(agg, "error_type", "left")
            .select("error_type", F.coalesce("n", F.lit(0)).alias("n"),
                    round_half_even("avg_recency", 1).alias("avg_recency"),
                    round_half_even("avg_frequency", 1).alias("avg_frequency")))


def regression_metrics(df: DataFrame, target: str = "clv_target", pred: str = "predicted_clv",
                       buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """MAE, RMSE (2 places), R^2 (4 places), median and mean prediction.

    Target and prediction have two decimals, so error sums are exact decimals."""
    y = F.col(target).cast("decimal(18,2)")
    p = F.col(pred).cast("decimal(18,2)")
    e = y - p
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).cast("double").alias("sae"),
               F.sum(e * e).cast("double").alias("sse"), F.sum(y).cast("double").alias("sy"),
               F.sum(y * y).cast("double").alias("syy"), F.sum(p).cast("double").alias("sp"))
    med = exact_quantiles(df, pred, [0.5], ["m"], buckets=buckets).select("m").scalar()
    n = F.col("n")
    ss_tot = F.col("syy") - F.col("sy") * F.col("sy") / n
    r2 = (F.when(ss_tot > 0, 1 - F.col("sse") / ss_tot)
          .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return s.select(round_half_even(F.col("sae") / n, 2).alias("mae"),
                    round_half_even(F.sqrt(F.col("sse") / n), 2).alias("rmse"),
                    round_half_even(r2, 4).alias("r2_score"),
                    round_half_even(med, 2).alias("median_predicted_clv"),
                    round_half_even(F.col("sp") / n, 2).alias("mean_predicted_clv"))
