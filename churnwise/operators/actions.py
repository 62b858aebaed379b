"""Value percentile, action quadrant and rule-based activation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise import config
from churnwise.functions.scalar import assign_action, money, round_half_even
from churnwise.operators.ranking import avg_rank_pct

CUST = "customer_unique_id"


def add_monetary_percentile(df: DataFrame, buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """Average-rank percentile of ``monetary`` over all customers."""
    return avg_rank_pct(df, "monetary", "monetary_percentile", buckets=buckets)


def add_action(df: DataFrame) -> DataFrame:
    """C2 on the 4-place probability (the class uses the raw score)."""
    return df.withColumn("action", assign_action("churn_probability", "monetary_percentile"))


def action_distribution(df: DataFrame) -> DataFrame:
    """All four actions (zero rows kept) with count and % of customers."""
    keys = F.explode(F.array(*[F.lit(a) for a in config.ACTIONS])).alias("action")
    counts = df.groupBy("action").agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    frame = df.sparkSession.range(1).select(keys)
    out = frame.join(counts, "action", "left").select(
        "action", F.coalesce("count", F.lit(0)).alias("count"))
    return out.withColumn("pct", round_half_even(F.col("count") / total * 100, 1))


def templates(spark) -> DataFrame:
    rows = [(a, *config.ACTION_TEMPLATES[a][:5]) for a in config.ACTIONS]
    return spark.createDataFrame(rows, "action string, channel string, template string, subject string, "
                                       "discount_pct int, urgency string")


def eligible(churn_threshold: float = config.ACTIVATION_CHURN_MIN,
             clv_threshold: float = config.ACTIVATION_CLV_MIN):
    """Activation rule: SAVE_NOW or NURTURE, SAVE_NOW needs a high probability,
    both need enough predicted value."""
    a = F.coalesce(F.col("action"), F.lit("MONITOR"))
    prob = F.coalesce(F.col("churn_probability"), F.lit(0.0))
    clv = F.coalesce(F.col("predicted_clv"), F.lit(0.0))
    return (a.isin(*config.ACTIVATED_ACTIONS)
            & ((a != "SAVE_NOW") | (prob >= churn_threshold))
            & (clv >= clv_threshold))


def activation_events(df: DataFrame, as_of, churn_threshold: float = config.ACTIVATION_CHURN_MIN,
                      clv_threshold: float = config.ACTIVATION_CLV_MIN) -> DataFrame:
    """One simulated campaign event per eligible customer.  ``as_of`` is
    the run time (a timestamp column or literal) in place of the clock."""
    fired = df.filter(eligible(churn_threshold, clv_threshold))
    tpl = F.broadcast(templates(df.sparkSession))            # 4 rows, fixed size
    return fired.join(tpl, "action", "inner").select(
        F.col(CUST).alias("customer_id"), "action", "channel", "template", "subject", "discount_pct",
        "urgency",
        round_half_even("churn_probability", 4).alias("churn_probability"),
        round_half_even("predicted_clv", 2).alias("predicted_clv"),
        F.coalesce(F.col("segment"), F.lit("Unknown")).alias("segment"),
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit(config.ACTIVATION_STATUS).alias("status"))


def recent_activations(events: DataFrame, n: int | None = None) -> DataFrame:
    """The activation events; with ``n`` the latest n, ties by customer id."""
    return events if n is None else events.orderBy(F.col("timestamp").desc(), "customer_id").limit(n)


def activation_summary(df: DataFrame, churn_threshold: float = config.ACTIVATION_CHURN_MIN,
                       clv_threshold: float = config.ACTIVATION_CLV_MIN) -> DataFrame:
    """A22 + A23: evaluated, activated, per-action counts, discount budget
    (predicted value x discount), activation rate and per-action shares."""
    ok = eligible(churn_threshold, clv_threshold)
    save = ok & (F.col("action") == "SAVE_NOW")
    nurture = ok & (F.col("action") == "NURTURE")
    pct = {a: config.ACTION_TEMPLATES[a][3] for a in config.ACTIONS}
    discount = F.when(save, money("predicted_clv") * pct["SAVE_NOW"] / 100)
    if pct["NURTURE"]:
        discount = discount.when(nurture, money("predicted_clv") * pct["NURTURE"] / 100)
    s = df.agg(F.count(F.lit(1)).alias("total_evaluated"),
               F.count_if(ok).alias("total_activated"),
               F.count_if(save).alias("save_now_fired"),
               F.count_if(nurture).alias("nurture_fired"),
               F.coalesce(F.sum(discount).cast("double"), F.lit(0.0)).alias("_budget"))
    rate = F.when(F.col("total_evaluated") > 0,
                  round_half_even(F.col("total_activated") / F.col("total_evaluated") * 100, 1)).otherwise(0.0)

    def share(c):
        return F.when(F.col("total_activated") > 0,
                      round_half_even(F.col(c) / F.col("total_activated") * 100, 1)).otherwise(0.0)
    return s.select("total_evaluated", "total_activated", "save_now_fired", "nurture_fired",
                    round_half_even("_budget", 2).alias("estimated_discount_budget"),
                    rate.alias("activation_rate_pct"),
                    share("save_now_fired").alias("save_now_share_pct"),
                    share("nurture_fired").alias("nurture_share_pct"))
