"""Certificates hold for right results and fail for results that were changed."""
import math
import threading

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnwise.functions.scalar import finite_or_zero
from churnwise.operators import actions, boosting, clv, evaluation, explain, ml
from churnwise.plans import certificates as C
from churnwise.plans import registry


def all_true(df, *flags):
    return all(bool(r[f]) for r in df.collect() for f in flags)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(f"c{i}", [float(i % 3 * 10 + i % 5 / 10), float(i % 3), 1.0], i % 3) for i in range(60)]
    scaled = spark.createDataFrame([(a, b) for a, b, _ in rows], "customer_unique_id string, x array<double>").select(
        "customer_unique_id", array_to_vector("x").alias("rfm_scaled"))
    customers = spark.createDataFrame([(a, c, ["Champions", "Loyalists", "At-Risk"][c]) for a, _, c in rows],
                                      "customer_unique_id string, cluster int, segment string")
    centres = [[sum(r[1][d] for r in rows if r[2] == k) / 20 for d in range(3)] for k in range(3)]
    return customers, scaled, centres


def test_clusters(spark, points):
    customers, scaled, centres = points
    moved = customers.withColumn("cluster", F.when(F.col("customer_unique_id") == "c7", 2).otherwise(F.col("cluster")))
    assert all_true(C.nearest_centres(*points), "nearest", "named") and all_true(C.centre_means(*points), "centre_is_mean")
    bad = C.nearest_centres(moved, scaled, centres).filter("NOT nearest").collect()
    assert [r.customer_unique_id for r in bad] == ["c7"]
    assert not all_true(C.centre_means(moved, scaled, centres), "centre_is_mean")
    assert not all_true(C.nearest_centres(customers.withColumn("segment", F.lit("Other")), scaled, centres), "named")
    cost = sum(sum((x - c) ** 2 for x, c in zip(r.x, centres[r.cluster]))
               for r in customers.join(scaled.select("customer_unique_id", ml.vector_to_array("rfm_scaled").alias("x")), "customer_unique_id").collect())
    flags = ("cost_falls", "best_is_highest", "cost_is_of_assignment")
    sweep = spark.createDataFrame([(2, cost * 2, 0.5, False), (3, cost, 0.9, True), (4, cost / 2, 0.7, False)], "k int, inertia double, silhouette double, best_k boolean")
    assert all_true(C.sweep_check(sweep, *points), *flags)
    for wrong in (sweep.withColumn("inertia", F.col("inertia") * 1.01), sweep.withColumn("best_k", F.col("k") == 2), sweep.withColumn("inertia", F.col("inertia") * F.col("k") * F.col("k"))):
        assert not all_true(C.sweep_check(wrong, *points), *flags)


def test_scores(spark):
    rows = []
    for i in range(40):
        phi = [0.1 * (i - 20), -0.05 * i, 0.7]
        p = 1 / (1 + math.exp(-(sum(phi) + 0.2)))
        pct = i / 40
        action = ("SAVE_NOW" if pct >= 0.5 else "LET_GO") if round(p, 4) >= 0.5 else ("NURTURE" if pct >= 0.5 else "MONITOR")
        rows.append((f"c{i}", round(p, 4), p, int(p > 0.5), pct, action, phi, 0.2))
    df = spark.createDataFrame(rows, "customer_unique_id string, churn_probability double, churn_score double, churn_prediction int, "
                                     "monetary_percentile double, action string, contributions array<double>, base_value double")
    scored, contrib, flags = df.drop("contributions", "base_value"), df.select("customer_unique_id", "contributions", "base_value"), ("score_is_sum", "class_follows", "action_follows")
    assert all_true(C.score_check(scored, contrib), *flags)
    for column, value in (("churn_probability", F.col("churn_probability") + 0.001), ("churn_prediction", 1 - F.col("churn_prediction")), ("action", F.lit("NURTURE"))):
        assert not all_true(C.score_check(scored.withColumn(column, value), contrib), *flags)
    reasons = df.select("customer_unique_id", F.posexplode(F.reverse(F.array_sort(F.transform("contributions", lambda v: F.struct(F.abs(v).alias("m"), v.alias("v")))))).alias("i", "r")) \
        .select("customer_unique_id", (F.col("i") + 1).alias("reason_rank"), F.round("r.v", 4).alias("shap_value"))
    assert all_true(C.reasons_check(reasons, contrib), "strongest_first", "first_is_largest")
    swapped = reasons.withColumn("reason_rank", 4 - F.col("reason_rank"))
    assert not all_true(C.reasons_check(swapped, contrib), "strongest_first")


def test_metrics_and_tiers(spark):
    df = spark.range(500).select(F.concat(F.lit("c"), F.col("id")).alias("customer_unique_id"), ((F.col("id") * 7) % 3 == 0).cast("int").alias("churned"),
                                 (((F.col("id") * 37) % 101) / 101).alias("churn_score"), F.col("id").cast("double").alias("recency"), F.lit(1).alias("frequency"),
                                 F.round(((F.col("id") * 13) % 97) * 1.25, 2).alias("predicted_clv"), F.round(((F.col("id") * 11) % 89) * 1.5, 2).alias("clv_target"))
    df = df.withColumn("churn_prediction", (F.col("churn_score") > 0.5).cast("int"))
    parts = [ml.churn_metrics(df), evaluation.confusion_counts(df), evaluation.classification_report(df), evaluation.error_analysis(df)]
    flags = ("accuracy_follows", "recall_follows", "auc_follows", "errors_follow")
    assert all_true(C.metrics_check(df, *parts), *flags)
    for c in ("accuracy", "recall", "roc_auc"):
        assert not all_true(C.metrics_check(df, parts[0].withColumn(c, F.col(c) + 0.001), *parts[1:]), *flags)
    flags = ("mae_follows", "rmse_follows", "r2_follows")
    m = evaluation.regression_metrics(df)
    assert all_true(C.regression_check(df, m), *flags) and not all_true(C.regression_check(df, m.withColumn("rmse", F.col("rmse") + 1)), *flags)
    tiers, th = clv.add_clv_tier(df), clv.clv_thresholds(df)
    assert all_true(C.tier_check(tiers, th), "not_negative", "two_places", "tier_follows")
    assert not all_true(C.tier_check(tiers.withColumn("clv_tier", F.lit("Gold")), th), "tier_follows")
    flags = [f"{c}_is_percentile" for c in ("platinum", "gold", "silver")]
    assert all_true(C.threshold_check(df, th), *flags) and not all_true(C.threshold_check(df, th.withColumn("gold", F.col("gold") - 5)), *flags)
    full = tiers.withColumns({"action": F.lit("SAVE_NOW"), "churn_probability": F.lit(0.9), "predicted_clv": F.col("predicted_clv") * 10, "segment": F.lit("At-Risk")})
    ev, flags = actions.activation_events(full, F.lit("2024-01-01").cast("timestamp")), ("none_missing", "none_extra", "summary_counts")
    assert ev.count() > 0 and all_true(C.activation_check(full, ev, actions.activation_summary(full)), *flags)
    assert not all_true(C.activation_check(full, ev.filter("predicted_clv > 500"), actions.activation_summary(full)), *flags)


def test_logistic_gradient(spark):
    rows = spark.range(400).select(((F.col("id") * 7919) % 1000 / 100).alias("a"), ((F.col("id") * 104729) % 777 / 50).alias("b"), "id")
    rows = rows.withColumn("churned", (F.col("a") + F.col("b") / 2 + (F.col("id") % 7) > 11).cast("int"))
    names = ["a", "b"]
    train = ml.VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    got = C.logistic_gradient(train)
    assert [r.flat for r in got.collect()][:2] == [True, True]


def test_contributions_are_held_against_the_model(spark, monkeypatch):
    """Contributions that agree with themselves but not with the model's trees are broken, and so are missing ones."""
    cols = ["a", "b"]
    feat = spark.createDataFrame([(f"c{i}" if i else None, float(i % 7), float("nan") if i == 3 else float(i % 5), float(i % 7 > 3)) for i in range(120)],
                                 "customer_unique_id string, a double, b double, label double")
    model = boosting.fit(feat, cols, "label", "logistic", n_trees=3, max_depth=3, row_sample=1.0, feature_sample=1.0)
    clean = feat.select("customer_unique_id", *[finite_or_zero(c).alias(c) for c in cols])
    monkeypatch.setattr(registry, "_features", lambda spark, sf: feat)
    monkeypatch.setattr(registry, "_churn", lambda spark, sf: {"model": model})

    def found(contrib):
        monkeypatch.setattr(registry, "_contributions", lambda spark, sf: contrib)
        return tuple(registry.q_contribution_check(spark, "").first())
    whole = explain.contributions(clean, model.explained(), cols)
    assert found(whole) == (120, 0)
    lost = explain.contributions(clean, model.explained()[1:], cols)              # a tree is left out
    assert found(lost) == (120, 120)
    assert found(whole.filter("NOT customer_unique_id <=> 'c5'")) == (120, 1)
    shifted = F.when(F.col("customer_unique_id") == "c9", F.transform("contributions", lambda v: v + 0.01)).otherwise(F.col("contributions"))
    assert found(whole.withColumn("margin", F.lit(0.0)).withColumn("contributions", shifted)) == (120, 1)


def test_activation_models_are_fitted_side_by_side(spark, monkeypatch):
    """The three fits behind the activation results wait for one another here, so one after another would never end."""
    meet = threading.Barrier(3, timeout=60)
    ids = [f"c{i}" for i in range(6)]

    def fit(found):
        def run(spark, sf):
            meet.wait()
            return found
        return run
    seg = spark.createDataFrame([(c, i % 2, "Champions") for i, c in enumerate(ids)], "customer_unique_id string, cluster int, segment string")
    val = spark.createDataFrame([(c, 100.0 * i, "Gold") for i, c in enumerate(ids)], "customer_unique_id string, predicted_clv double, clv_tier string")
    scored = spark.createDataFrame([(c, i / 5, ["NURTURE", "SAVE_NOW"][i % 2]) for i, c in enumerate(ids)],
                                   "customer_unique_id string, churn_probability double, action string")
    monkeypatch.setattr(registry, "_MEMO", {})
    monkeypatch.setattr(registry, "_features", lambda spark, sf: None)
    monkeypatch.setattr(registry, "_clean", lambda spark, sf: None)
    monkeypatch.setattr(registry.batch, "run_time", lambda clean: F.lit("2024-01-01").cast("timestamp"))
    for name, found in (("_segments", {"customers": seg}), ("_churn_scored", scored), ("_clv", {"customers": val})):
        monkeypatch.setattr(registry, name, fit(found))
    assert [tuple(r) for r in registry.q_activation_certificate(spark, "").collect()] == [(6, True, True, True)]
