"""Value tiers and value statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise import config
from churnwise.functions.scalar import assign_clv_tier, round_half_even
from churnwise.operators.ranking import exact_quantiles


def clip_and_round(c) -> F.Column:
    """predictions below 0 become 0, then 2 places."""
    return round_half_even(F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(0.0)), 2)


def clv_thresholds(df: DataFrame, col: str = "predicted_clv", buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """One row with the 95th / 80th / 50th percentile of predicted value."""
    return exact_quantiles(df, col, list(config.TIER_PERCENTILES), ["platinum", "gold", "silver"],
                           buckets=buckets)


def add_clv_tier(df: DataFrame, col: str = "predicted_clv", buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """C3 with percentile thresholds computed over the same frame (one scalar subquery for all three)."""
    th = clv_thresholds(df, col, buckets).select(F.struct("platinum", "gold", "silver")).scalar()
    tier = assign_clv_tier(col, F.col("_th.platinum"), F.col("_th.gold"), F.col("_th.silver"))
    return df.withColumn("_th", th).withColumn("clv_tier", tier).drop("_th")


def tier_table(df: DataFrame, col: str = "predicted_clv", buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """The four tiers with their share label and lower threshold (Bronze 0)."""
    th = clv_thresholds(df, col, buckets)
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("tier_rank"), F.lit(name).alias("tier"), F.lit(label).alias("share"),
                 (F.col(k) if k else F.lit(0.0)).alias("threshold"))
        for i, (name, label, k) in enumerate(zip(config.TIER_NAMES, config.TIER_SHARE_LABELS,
                                                 ("platinum", "gold", "silver", None)))]))
    return th.select(rows.alias("t")).select("t.*")
