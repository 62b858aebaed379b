"""Named queries: each takes (spark, sf_dir) and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise import config
from churnwise.functions.scalar import feature_label, finite_or_zero, round_half_even
from churnwise.operators import actions, clv, evaluation, explain, features, histogram, ml, orders, reports, segments
from churnwise.plans import batch, certificates
from churnwise.session import cut_lineage, stage_path
from churnwise.sources import sinks
from churnwise.sources.tables import load_order_tables, load_uploaded_csv, write_order_tables
from churnwise.sources.testdata import load_test_tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


_MEMO: dict = {}


def _memo(spark, sf, name, build):
    """Stage outputs are written once per session and data folder, then shared by the queries."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def _clean(spark, sf):
    return _memo(spark, sf, "clean", lambda: batch.order_stage(load_test_tables(spark, sf)))


def _features(spark, sf):
    return _memo(spark, sf, "features", lambda: batch.feature_stage(_clean(spark, sf)))


@query("payments_per_order")
def q_payments(spark, sf):
    return orders.payments_per_order(load_test_tables(spark, sf).payments)


@query("items_per_order")
def q_items(spark, sf):
    return orders.items_per_order(load_test_tables(spark, sf).items)


@query("categories_per_order")
def q_categories(spark, sf):
    t = load_test_tables(spark, sf)
    return orders.categories_per_order(t.items, t.products)


@query("latest_review")
def q_latest_review(spark, sf):
    return orders.latest_review(load_test_tables(spark, sf).reviews)


@query("first_review")
def q_first_review(spark, sf):
    return orders.first_review(load_test_tables(spark, sf).reviews)


@query("order_master")
def q_master(spark, sf):
    return orders.merge_orders(load_test_tables(spark, sf))


@query("clean_orders")
def q_clean(spark, sf):
    return _clean(spark, sf)


@query("time_split_counts")
def q_split(spark, sf):
    return features.time_split_counts(_clean(spark, sf))


@query("feature_matrix")
def q_feature_matrix(spark, sf):
    return _features(spark, sf)


@query("customer_features")
def q_features(spark, sf):
    return _features(spark, sf).drop("target_purchases", "target_revenue", "churned", "clv_target")


@query("churn_labels")
def q_labels(spark, sf):
    return (_features(spark, sf)
            .select("customer_unique_id", "target_purchases", "target_revenue", "churned", "clv_target"))


@query("target_outcomes")
def q_targets(spark, sf):
    return features.target_outcomes(_clean(spark, sf))


def _scored(spark, sf):
    return _memo(spark, sf, "scored", lambda: batch.proxy_scores(_features(spark, sf), cut=True))


@query("monetary_percentile")
def q_pct(spark, sf):
    return _scored(spark, sf).select("customer_unique_id", "monetary", "monetary_percentile")


@query("action_matrix")
def q_action_matrix(spark, sf):
    return _scored(spark, sf).select("customer_unique_id", "monetary", "churn_probability",
                                     "monetary_percentile", "segment", "action")


@query("action_distribution")
def q_action_dist(spark, sf):
    return actions.action_distribution(_scored(spark, sf))


@query("clv_thresholds")
def q_clv_thresholds(spark, sf):
    return clv.clv_thresholds(_scored(spark, sf))


@query("clv_tiers")
def q_clv_tiers(spark, sf):
    return _scored(spark, sf).select("customer_unique_id", "predicted_clv", "clv_tier")


@query("tier_table")
def q_tier_table(spark, sf):
    return clv.tier_table(_scored(spark, sf))


@query("segment_distribution")
def q_seg_dist(spark, sf):
    return reports.value_counts(_scored(spark, sf), "segment")


@query("tier_distribution")
def q_tier_dist(spark, sf):
    return reports.value_counts(_scored(spark, sf), "clv_tier")


@query("share_by_segment")
def q_share_seg(spark, sf):
    return reports.share_of_total(_scored(spark, sf), "segment")


@query("share_by_tier")
def q_share_tier(spark, sf):
    return reports.share_of_total(_scored(spark, sf), "clv_tier")


@query("segment_summary")
def q_seg_summary(spark, sf):
    return segments.segment_summary(_scored(spark, sf))


@query("rank_and_name_groups")
def q_name_groups(spark, sf):
    return segments.name_clusters(segments.cluster_summary(_scored(spark, sf)))


@query("confusion_counts")
def q_confusion(spark, sf):
    return evaluation.confusion_counts(_scored(spark, sf))


@query("threshold_metrics")
def q_threshold_metrics(spark, sf):
    return evaluation.threshold_metrics(_scored(spark, sf))


@query("classification_report")
def q_class_report(spark, sf):
    return evaluation.classification_report(_scored(spark, sf))


@query("error_analysis")
def q_error_analysis(spark, sf):
    return evaluation.error_analysis(_scored(spark, sf))


@query("regression_metrics")
def q_regression(spark, sf):
    return evaluation.regression_metrics(_scored(spark, sf))


@query("dashboard_kpis")
def q_kpis(spark, sf):
    return reports.dashboard_kpis(_scored(spark, sf))


@query("dashboard_stats")
def q_dashboard_stats(spark, sf):
    """R8 over the stand-in scores: KPIs, threshold metrics, value stats, value metrics."""
    from churnwise.plans.serving import dashboard_stats
    s = _scored(spark, sf)
    return dashboard_stats(s, evaluation.threshold_metrics(s), evaluation.regression_metrics(s))


@query("clv_stats")
def q_clv_stats(spark, sf):
    return reports.clv_stats(_scored(spark, sf))


@query("churn_histogram")
def q_hist(spark, sf):
    return histogram.histogram(_scored(spark, sf), "churn_probability")


@query("churn_histogram_by_segment")
def q_hist_seg(spark, sf):
    return histogram.histogram(_scored(spark, sf), "churn_probability", group_cols=["segment"])


@query("rfm_box_stats")
def q_box(spark, sf):
    return reports.rfm_box_stats(_scored(spark, sf))


@query("quadrant_lines")
def q_quadrant(spark, sf):
    return reports.quadrant_lines(_scored(spark, sf))


@query("top_clv")
def q_top_clv(spark, sf):
    return reports.top_clv(_scored(spark, sf))


@query("segment_drilldown")
def q_drilldown(spark, sf):
    return reports.segment_drilldown(_scored(spark, sf))


@query("segment_drilldown_champions")
def q_drilldown_champions(spark, sf):
    return reports.segment_drilldown(_scored(spark, sf), "Champions")


@query("customer_list")
def q_customer_list(spark, sf):
    return reports.customer_list(_scored(spark, sf))


@query("scatter_points")
def q_scatter(spark, sf):
    return reports.scatter_points(_scored(spark, sf))


@query("export_action")
def q_export_action(spark, sf):
    return reports.export_action(_scored(spark, sf), "save_now")


@query("export_customers")
def q_export_customers(spark, sf):
    return reports.export_customers(_scored(spark, sf))


@query("export_customers_filtered")
def q_export_customers_filtered(spark, sf):
    return reports.export_customers(_scored(spark, sf), "churned", "champions")


@query("stage_audit")
def q_audit(spark, sf):
    """Row counts per stage and the churn rate of the labelled customers."""
    raw = orders.merge_orders(load_test_tables(spark, sf)).agg(F.count(F.lit(1))).scalar()
    clean = _clean(spark, sf).agg(F.count(F.lit(1))).scalar()
    return _features(spark, sf).agg(F.count(F.lit(1)).alias("customers"),
                                    F.avg("churned").alias("_c")).select(
        raw.alias("raw_orders"), clean.alias("clean_orders"), "customers",
        round_half_even(F.col("_c") * 100, 1).alias("churn_rate"))


@query("column_stats")
def q_column_stats(spark, sf):
    """Count / mean / stddev / min / quartiles / max of every feature column."""
    return reports.column_stats(_features(spark, sf).drop("customer_unique_id"))


@query("top_risk_customers")
def q_top_risk(spark, sf):
    """The highest-risk customers (ties by id)."""
    return reports.top_by(_scored(spark, sf), "churn_probability", 100,
                          ["customer_unique_id", "churn_probability", "segment", "monetary"])


def _activation_events(spark, sf):
    return actions.activation_events(_scored(spark, sf), batch.run_time(_clean(spark, sf)))


@query("activation_events")
def q_activation_events(spark, sf):
    return _activation_events(spark, sf)


@query("recent_activations")
def q_recent_activations(spark, sf):
    return actions.recent_activations(_activation_events(spark, sf))


@query("activation_summary")
def q_activation_summary(spark, sf):
    return actions.activation_summary(_scored(spark, sf))


# ---------------------------------------------------------------- feed and live store (batch twins)

@query("order_feed")
def q_feed(spark, sf):
    from churnwise.sources.feed import order_feed
    return order_feed(load_test_tables(spark, sf))


@query("order_feed_head")
def q_feed_head(spark, sf):
    from churnwise.sources.feed import order_feed
    return order_feed(load_test_tables(spark, sf), limit=500)


@query("order_payloads")
def q_payloads(spark, sf):
    from churnwise.sources.feed import order_feed, to_payload
    return to_payload(order_feed(load_test_tables(spark, sf)))


def _purchases(spark, sf):
    from churnwise.sources.testdata import load_purchase_events
    return load_purchase_events(spark, sf)


@query("live_profiles")
def q_live_profiles(spark, sf):
    from churnwise.streaming.live import dedupe_batch, profiles, valid_rows
    ev = _purchases(spark, sf)
    now = ev.agg(F.max("order_timestamp")).scalar()
    return profiles(dedupe_batch(ev.filter(valid_rows(ev))), now)


@query("live_stats")
def q_live_stats(spark, sf):
    from churnwise.streaming.live import dedupe_batch, live_stats, valid_rows
    ev = _purchases(spark, sf).filter(valid_rows(_purchases(spark, sf)))
    return live_stats(ev.select("customer_id"), dedupe_batch(ev))


@query("intake_counts")
def q_intake(spark, sf):
    from churnwise.streaming.live import intake_counts
    return intake_counts(_purchases(spark, sf))


@query("unprocessed_orders")
def q_unprocessed(spark, sf):
    from churnwise.functions.scalar import add_days
    from churnwise.streaming.live import unprocessed_orders
    ev = _purchases(spark, sf)
    horizon = add_days(ev.agg(F.max("order_timestamp")).scalar(), -7)
    return unprocessed_orders(ev, ev.filter(F.col("order_timestamp") < horizon))


# ---------------------------------------------------------------- the live store, replayed batch by batch (checked in SQL)

REPLAY_BATCHES, REPLAY_MEAN_VALUE = 4, 50.0


def _replay_lines(spark, sf):
    """The purchase feed as JSON lines in four batches: every 97th line is cut, every 101st has no value, every 7th order is sent again."""
    from churnwise.sources.feed import to_payload
    n = F.col("order_id").cast("long")
    ev = _purchases(spark, sf).withColumn("total_value", F.when(n % 101 != 0, F.col("total_value")))
    lines = to_payload(ev).withColumn("n", F.get_json_object("value", "$.order_id").cast("long"))
    lines = lines.withColumn("value", F.when(F.col("n") % 97 == 0, F.expr("left(value, length(value) div 2)")).otherwise(F.col("value")))
    first = lines.select("value", (F.col("n") % REPLAY_BATCHES).alias("batch"), "n")
    again = first.filter(f"n % 7 = 0 AND batch < {REPLAY_BATCHES - 1}").withColumn("batch", F.col("batch") + 1)
    return first.unionByName(again).drop("n")


def _live_scores(profiles):
    """T6 stand-in: customers of a mean order of ``REPLAY_MEAN_VALUE`` or more are nurtured."""
    return profiles.select("customer_id", F.when(F.col("avg_order_value") >= REPLAY_MEAN_VALUE, "NURTURE").otherwise("MONITOR").alias("action"),
                           F.lit(0.1).alias("churn_probability"), F.col("monetary_total").alias("predicted_clv"), F.lit("Live").alias("segment"))


def _replay(spark, sf) -> str:
    """A store that the batches of the feed went through, one after another, with its history compacted on the way."""
    from uuid import uuid4

    from churnwise.session import ensure_checkpoint_dir
    from churnwise.streaming import live

    def build():
        store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/live-{uuid4().hex}"
        lines = cut_lineage(_replay_lines(spark, sf), "replay_lines")
        as_of = _purchases(spark, sf).agg(F.max("order_timestamp")).first()[0]
        for b in range(REPLAY_BATCHES):
            live.process_batch(live.parse_lines(lines.filter(F.col("batch") == b).select("value")), b, store, as_of, _live_scores, compact_every=2, buckets=8)
        return store
    return _memo(spark, sf, "live_replay", build)


@query("replayed_orders")
def q_replayed_orders(spark, sf):
    """T1 + T3: every order once, with the batch that brought it first."""
    from churnwise.streaming import live
    return live.stored(spark, _replay(spark, sf), "orders").select("order_id", "customer_id", "total_value", "order_timestamp", "review_score", "batch_id")


@query("replayed_customers")
def q_replayed_customers(spark, sf):
    """T2 + T4: the customer state after the last batch."""
    from churnwise.streaming import live
    return live.current_state(spark, _replay(spark, sf)).select(
        "customer_id", "first_batch", "n_orders", F.col("value_sum").cast("double").alias("value_sum"), "first_purchase", "last_purchase", "above")


@query("replayed_counts")
def q_replayed_counts(spark, sf):
    """T5: accepted, duplicate and broken events of every batch."""
    from churnwise.streaming import live
    return live.stored(spark, _replay(spark, sf), "audit")


@query("replayed_quarantine")
def q_replayed_quarantine(spark, sf):
    """The broken lines as they came, with the reason."""
    from churnwise.streaming import live
    return live.stored(spark, _replay(spark, sf), "quarantine").select("line", "reason", "batch_id")


@query("replayed_activations")
def q_replayed_activations(spark, sf):
    """One event for each time a customer crosses the rule."""
    from churnwise.streaming import live
    return live.stored(spark, _replay(spark, sf), "activations").select("customer_id", "action", "template", "predicted_clv", "timestamp", "batch_id")


@query("replayed_stats")
def q_replayed_stats(spark, sf):
    """A24 from the customer state."""
    from churnwise.streaming import live
    return live.store_stats(spark, _replay(spark, sf))


# ---------------------------------------------------------------- model-backed (rows-only)
# One memo per step: a query trains only what it shows.

def _segments(spark, sf):
    from churnwise.plans import models
    return _memo(spark, sf, "m_segments", lambda: models.run_segments(_features(spark, sf), sweep=False))


def _churn(spark, sf):
    from churnwise.plans import models
    return _memo(spark, sf, "m_churn", lambda: models.fit_churn(_features(spark, sf)))


def _churn_scored(spark, sf):
    from churnwise.plans import models
    return _memo(spark, sf, "m_churn_scored", lambda: models.score_churn(_churn(spark, sf)["model"], _features(spark, sf)))


def _contributions(spark, sf):
    from churnwise.plans import models
    return _memo(spark, sf, "m_contributions",
                 lambda: models.explain_churn(_churn(spark, sf)["model"], _features(spark, sf), as_of=batch.run_time(_clean(spark, sf))))


def _clv(spark, sf):
    from churnwise.plans import models
    return _memo(spark, sf, "m_clv", lambda: models.run_clv(_features(spark, sf)))


def _customers(spark, sf):
    """Customers with probability, action, segment, predicted value and tier."""
    def build():
        _features(spark, sf)
        # the three fits need only the features: their many small jobs share the executors
        with ThreadPoolExecutor(max_workers=3) as ex:
            seg, scored, val = [f.result() for f in [ex.submit(step, spark, sf) for step in (_segments, _churn_scored, _clv)]]
        seg = seg["customers"].select("customer_unique_id", "cluster", "segment")
        val = val["customers"].select("customer_unique_id", "predicted_clv", "clv_tier")
        return cut_lineage(scored.join(seg, "customer_unique_id").join(val, "customer_unique_id"), "model_customers")
    return _memo(spark, sf, "m_customers", build)


@query("kmeans_segments")
def q_kmeans(spark, sf):
    return _segments(spark, sf)["customers"].select("customer_unique_id", "cluster", "segment")


@query("k_sweep")
def q_k_sweep(spark, sf):
    from churnwise.plans import models
    return _memo(spark, sf, "m_sweep", lambda: models.run_sweep(_features(spark, sf)))


@query("model_segment_summary")
def q_model_segments(spark, sf):
    return _segments(spark, sf)["segment_summary"]


@query("churn_scores")
def q_churn_scores(spark, sf):
    return _churn_scored(spark, sf).select("customer_unique_id", "churn_probability", "churn_prediction",
                                           "monetary_percentile", "action")


for _name, _key in [("churn_metrics", "metrics"), ("churn_confusion", "confusion"),
                    ("churn_classification_report", "classification_report"), ("churn_error_analysis", "error_analysis")]:
    REGISTRY[_name] = (lambda key: lambda spark, sf: _churn(spark, sf)[key])(_key)


@query("churn_auc")
def q_churn_auc(spark, sf):
    return ml.auc(_churn(spark, sf)["test_scored"])


@query("baselines")
def q_baselines(spark, sf):
    fit = _churn(spark, sf)
    return ml.baselines(fit["train"], fit["test"], fit["test_scored"])


@query("churn_reasons")
def q_reasons(spark, sf):
    """The three strongest reasons of every customer."""
    return explain.top_reasons(_churn_scored(spark, sf), _contributions(spark, sf), None)


@query("feature_importance")
def q_importance(spark, sf):
    return explain.feature_importance(_contributions(spark, sf))


@query("top_features")
def q_top_features(spark, sf):
    """Features by importance with their readable labels."""
    imp = explain.feature_importance(_contributions(spark, sf))
    return imp.select("feature", feature_label("feature").alias("label"), "importance")


@query("explained_customers")
def q_explained(spark, sf):
    """J10 + L6: the reasons of the explained high-risk customers joined to their rows."""
    from churnwise.plans.serving import explained_customers
    reasons = explain.top_reasons(_churn_scored(spark, sf), _contributions(spark, sf), config.EXPLAIN_TOP_N)
    seg = _segments(spark, sf)["customers"].select("customer_unique_id", "segment")
    return explained_customers(_churn_scored(spark, sf).join(seg, "customer_unique_id"), reasons)


@query("contribution_check")
def q_contribution_check(spark, sf):
    """Contributions add up to the margin that the model's own trees give; customers where they do not, or that have none (0)."""
    return certificates.contribution_check(_contributions(spark, sf), _features(spark, sf), _churn(spark, sf)["model"])


@query("clv_scores")
def q_clv_scores(spark, sf):
    return _clv(spark, sf)["customers"].select("customer_unique_id", "predicted_clv", "clv_tier")


@query("clv_metrics")
def q_clv_metrics(spark, sf):
    return _clv(spark, sf)["metrics"]


@query("clv_model_thresholds")
def q_clv_model_thresholds(spark, sf):
    return _clv(spark, sf)["thresholds"]


@query("model_activation_events")
def q_model_events(spark, sf):
    return actions.activation_events(_customers(spark, sf), batch.run_time(_clean(spark, sf)))


@query("model_activation_summary")
def q_model_activation(spark, sf):
    return actions.activation_summary(_customers(spark, sf))


@query("model_dashboard_stats")
def q_model_dashboard(spark, sf):
    """R8 on the model outputs."""
    from churnwise.plans.serving import dashboard_stats
    return dashboard_stats(_customers(spark, sf), _churn(spark, sf)["metrics"], _clv(spark, sf)["metrics"],
                           batch.run_time(_clean(spark, sf)))


@query("model_status")
def q_model_status(spark, sf):
    from churnwise.plans import models
    _contributions(spark, sf)                       # saves the model
    return models.status(_churn_scored(spark, sf))


@query("model_dashboard_kpis")
def q_model_kpis(spark, sf):
    return reports.dashboard_kpis(_churn_scored(spark, sf))


@query("model_churn_histogram")
def q_model_hist(spark, sf):
    return histogram.histogram(_churn_scored(spark, sf), "churn_probability")


# ---------------------------------------------------------------- files written and read back

def _csv_orders(spark, sf):
    """The six tables in their CSV layout, written once per session and data folder."""
    def build():
        folder = stage_path(spark, "orders_csv")
        write_order_tables(load_test_tables(spark, sf), folder)
        return folder
    return _memo(spark, sf, "csv_orders", build)


@query("csv_clean_orders")
def q_csv_clean(spark, sf):
    """S1 + F3: the order tables as CSV text, read by their layouts, dates parsed, merged and cleaned."""
    return _memo(spark, sf, "csv_clean", lambda: batch.order_stage(load_order_tables(spark, _csv_orders(spark, sf))))


@query("uploaded_orders")
def q_uploaded(spark, sf):
    """The orders file as an upload, mapped by its column names; a third of its dates is broken."""
    def build():
        folder = stage_path(spark, "uploaded_csv")
        t = load_test_tables(spark, sf)
        when = F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")
        broken = F.when(F.col("order_id").cast("long") % 3 == 0, F.concat(F.lit("on "), when)).otherwise(when)
        (t.orders.join(t.payments, "order_id").select("customer_id", "order_id", broken.alias("bought"), F.col("payment_value").alias("paid"))
         .write.option("header", True).csv(folder))
        return folder
    return load_uploaded_csv(spark, _memo(spark, sf, "uploaded", build), "customer_id", "bought", "paid", "order_id")


@query("quoted_csv_export")
def q_quoted_export(spark, sf):
    """S8 + S9: the customer export as fully quoted CSV, read back."""
    export = reports.export_customers(_scored(spark, sf))

    def build():
        folder = stage_path(spark, "quoted_csv")
        sinks.write_csv(export, folder, quote_all=True)
        return folder
    return sinks.read_csv_as(spark, _memo(spark, sf, "quoted", build), export.schema)


# ---------------------------------------------------------------- certificates of the model results (checked in SQL)

def _rfm_scaled(spark, sf):
    return _memo(spark, sf, "m_rfm_scaled", lambda: cut_lineage(ml.scale_rfm(_features(spark, sf).select("customer_unique_id", *ml.RFM)), "rfm_scaled"))


def _centred(spark, sf):
    """(customers, scaled points, centres) of the segment run."""
    seg = _segments(spark, sf)
    return seg["customers"], _rfm_scaled(spark, sf), seg["kmeans"].clusterCenters()


@query("segments_certificate")
def q_segments_certificate(spark, sf):
    return certificates.nearest_centres(*_centred(spark, sf))


@query("centres_certificate")
def q_centres_certificate(spark, sf):
    return certificates.centre_means(*_centred(spark, sf))


@query("k_sweep_certificate")
def q_sweep_certificate(spark, sf):
    return certificates.sweep_check(q_k_sweep(spark, sf), *_centred(spark, sf))


@query("segment_summary_certificate")
def q_segment_summary_certificate(spark, sf):
    seg = _segments(spark, sf)
    return certificates.segment_totals(seg["segment_summary"], seg["customers"])


@query("churn_scores_certificate")
def q_scores_certificate(spark, sf):
    return certificates.score_check(_churn_scored(spark, sf), _contributions(spark, sf))


@query("churn_metrics_certificate")
def q_metrics_certificate(spark, sf):
    fit = _churn(spark, sf)
    return certificates.metrics_check(fit["test_scored"], fit["metrics"], fit["confusion"], fit["classification_report"], fit["error_analysis"])


@query("logistic_certificate")
def q_logistic_certificate(spark, sf):
    return certificates.logistic_gradient(_churn(spark, sf)["train"])


@query("baselines_certificate")
def q_baselines_certificate(spark, sf):
    return certificates.baselines_check(q_baselines(spark, sf), _churn(spark, sf)["metrics"])


@query("reasons_certificate")
def q_reasons_certificate(spark, sf):
    return certificates.reasons_check(q_reasons(spark, sf), _contributions(spark, sf))


@query("importance_certificate")
def q_importance_certificate(spark, sf):
    return certificates.importance_check(q_top_features(spark, sf), _contributions(spark, sf))


@query("explained_certificate")
def q_explained_certificate(spark, sf):
    return certificates.explained_check(q_explained(spark, sf), _churn_scored(spark, sf))


@query("clv_scores_certificate")
def q_clv_scores_certificate(spark, sf):
    return certificates.tier_check(_clv(spark, sf)["customers"], _clv(spark, sf)["thresholds"])


@query("clv_thresholds_certificate")
def q_clv_thresholds_certificate(spark, sf):
    return certificates.threshold_check(_clv(spark, sf)["customers"], _clv(spark, sf)["thresholds"])


@query("clv_metrics_certificate")
def q_clv_metrics_certificate(spark, sf):
    return certificates.regression_check(_clv(spark, sf)["test_scored"], _clv(spark, sf)["metrics"])


@query("model_activation_certificate")
def q_activation_certificate(spark, sf):
    return certificates.activation_check(_customers(spark, sf), q_model_events(spark, sf), q_model_activation(spark, sf))


@query("model_dashboard_certificate")
def q_dashboard_certificate(spark, sf):
    return certificates.dashboard_check(q_model_dashboard(spark, sf), q_model_kpis(spark, sf), _churn(spark, sf)["metrics"],
                                        _clv(spark, sf)["metrics"], _customers(spark, sf))


@query("model_histogram_certificate")
def q_histogram_certificate(spark, sf):
    return certificates.histogram_check(q_model_hist(spark, sf), _churn_scored(spark, sf))


# ---------------------------------------------------------------- model operators on stand-in columns (checked in SQL)

@query("standard_rfm")
def q_standard_rfm(spark, sf):
    """M1: recency, frequency and monetary standardised."""
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array(F.col("rfm_scaled"))
    z = ml.scale_rfm(_features(spark, sf).select("customer_unique_id", *ml.RFM))
    return z.select("customer_unique_id", *[round_half_even(F.get(x, F.lit(i)), 4).alias(f"z_{c}") for i, c in enumerate(ml.RFM)])


@query("feature_vector")
def q_feature_vector(spark, sf):
    """F9 + F10: the cleaned feature vector, one column per place."""
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array(F.col("features"))
    return ml.assemble(_features(spark, sf)).select(
        "customer_unique_id", *[F.get(x, F.lit(i)).alias(f"f_{c}") for i, c in enumerate(config.FEATURE_COLS)])


@query("split_sizes")
def q_split_sizes(spark, sf):
    """M5 + M6 + M7: rows and held-out rows per class of the stratified split, of the plain split, and the class weight."""
    feat = _features(spark, sf)
    per = ml.split_flag(feat, config.TEST_SIZE, config.RANDOM_STATE, "churned").groupBy("churned").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if("is_test").alias("held_out"))
    plain = ml.split_flag(feat, config.TEST_SIZE, config.RANDOM_STATE).agg(F.count_if("is_test")).scalar()
    weight = ml.with_class_weight(feat).groupBy("churned").agg(round_half_even(F.max("weight"), 6).alias("weight"))
    return per.join(weight, "churned").withColumn("plain_held_out", plain)


@query("proxy_auc")
def q_proxy_auc(spark, sf):
    """Exact AUC of the stand-in probability, many ties included."""
    return ml.auc(_scored(spark, sf), score="churn_probability")


def _standin_contributions(spark, sf):
    """Contributions by a fixed rule: feature value times (-1)^i / (i + 1), for the checkable explanation queries."""
    cols = config.FEATURE_COLS
    phi = F.array(*[finite_or_zero(c) * F.lit((-1.0) ** i / (i + 1)) for i, c in enumerate(cols)])
    return _scored(spark, sf).select("customer_unique_id", phi.alias("contributions"))


@query("standin_reasons")
def q_standin_reasons(spark, sf):
    """W5 + C7 + C8: the three strongest features of every customer, as texts, on stand-in contributions."""
    return explain.top_reasons(_scored(spark, sf), _standin_contributions(spark, sf), None)


@query("standin_importance")
def q_standin_importance(spark, sf):
    """M17 + L8 on stand-in contributions."""
    imp = explain.feature_importance(_standin_contributions(spark, sf))
    return imp.select("feature", feature_label("feature").alias("label"), round_half_even("importance", 4).alias("importance"))


@query("descriptions")
def q_descriptions(spark, sf):
    """Segments and actions in use with their descriptions."""
    return reports.descriptions(_scored(spark, sf))


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
