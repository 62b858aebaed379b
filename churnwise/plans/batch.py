"""Composed runs over the order tables (R1) and the checkable score stand-ins.

``proxy_scores`` fills the model columns (probability, class, cluster,
segment, predicted value) with fixed formulas of the features, so that every
report operator can be checked against SQL; the model runs in
:mod:`churnwise.plans.models` fill the same columns from Spark ML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from churnwise.config import Params
from churnwise.functions.scalar import round_half_even
from churnwise.operators import actions, clv, features, orders, segments
from churnwise.session import cut_lineage
from churnwise.sources.tables import OrderTables

TS = "order_purchase_timestamp"


def clean_order_frame(t: OrderTables, params: Params = Params()) -> DataFrame:
    """Merged and cleaned orders as one lazy plan (no materialisation)."""
    return orders.clean_orders(orders.merge_orders(t), params.rank_buckets)


def order_stage(t: OrderTables, params: Params = Params(), cut: bool = True,
                audit: dict | None = None) -> DataFrame:
    """Merged, filtered orders written to the checkpoint folder, then the
    median fill on top.  The median, the cutoff and the feature aggregate all
    read the written stage instead of replaying the five-table merge.

    With ``audit`` (a dict), row counts of the merged and the kept orders are
    collected by ``observe()`` while the stage is written: no extra pass.  (The
    observed merge counts every order, so the status filter then applies above
    the merge joins instead of below them; auditing is opt-in for that reason.)"""
    master = orders.merge_orders(t)
    if audit is not None:
        audit["_merged"] = Observation("merged_orders")
        master = master.observe(audit["_merged"], F.count(F.lit(1)).alias("raw_orders"))
    kept = orders.keep_orders(master)
    if audit is not None:
        audit["_kept"] = Observation("kept_orders")
        kept = kept.observe(audit["_kept"], F.count(F.lit(1)).alias("clean_orders"))
    if cut:
        kept = cut_lineage(kept, "kept_orders")
    return orders.finish_clean(kept, params.rank_buckets)


def feature_stage(clean: DataFrame, params: Params = Params(), cut: bool = True,
                  audit: dict | None = None) -> DataFrame:
    f = features.customer_features(clean, params.horizon_days)
    if audit is not None:
        audit["_features"] = Observation("features")
        f = f.observe(audit["_features"], F.count(F.lit(1)).alias("customers"),
                      F.sum("churned").alias("churned"))
    return cut_lineage(f, "features") if cut else f


def run_data(t: OrderTables, params: Params = Params(), cut: bool = True,
             audit: dict | None = None) -> DataFrame:
    """Load -> merge -> clean -> customer features with labels.

    Pass ``audit={}`` to get the stage counts and churn rate (A26) filled in
    after the run, from metrics observed while the stages were written."""
    out = feature_stage(order_stage(t, params, cut, audit), params, cut, audit)
    if audit is not None and cut:
        merged, kept, feats = (audit.pop(k).get for k in ("_merged", "_kept", "_features"))
        audit.update(merged)
        audit.update(kept)
        n = feats["customers"]
        rate = 100.0 * (feats["churned"] or 0) / max(n, 1)
        audit.update({"customers": n, "churn_rate": round_half_even_py(rate, 1)})
    return out


def round_half_even_py(x: float, digits: int) -> float:
    """The scalar twin of ``functions.scalar.round_half_even`` (numpy rint semantics)."""
    import numpy as np
    return float(np.rint(x * 10 ** digits) / 10 ** digits)


def run_time(clean: DataFrame):
    """The run's reference time: last purchase + 1 day (stands in for the clock)."""
    from churnwise.functions.scalar import add_days
    return add_days(clean.agg(F.max(TS)).scalar(), 1)


def proxy_scores(feat: DataFrame, params: Params = Params(), cut: bool = False) -> DataFrame:
    """Stand-in model columns (named as proxies, never presented as models):

    * probability = min(1, recency / 365), 4 places; class = raw score > 0.5
    * cluster     = min(k - 1, floor(recency / 180))
    * segment     = quartile of the monetary percentile
    * predicted   = monetary / frequency, clipped at 0, 2 places
    """
    raw = F.least(F.lit(1.0), F.col("recency") / 365.0)
    df = feat.withColumns({
        "churn_probability": round_half_even(raw, 4),
        "churn_prediction": (raw > 0.5).cast("int"),
        "cluster": F.least(F.lit(params.n_clusters - 1), F.floor(F.col("recency") / 180)).cast("int"),
        "predicted_clv": clv.clip_and_round(F.col("monetary") / F.col("frequency")),
    })
    df = actions.add_monetary_percentile(df, params.rank_buckets)
    df = df.withColumn("segment", segments.rule_segment())
    df = actions.add_action(df)
    if cut:
        df = cut_lineage(df, "proxy_scores")
    df = clv.add_clv_tier(df, buckets=params.rank_buckets)
    return cut_lineage(df, "proxy_scored") if cut else df

