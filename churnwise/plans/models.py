"""Model runs: segments (R2), churn (R3), value (R4), activation (R5), all (R6), status.

Each step takes written stages and returns DataFrames (and fitted models), so
a caller runs only the steps whose results it shows.  ``run_all`` runs them
all and writes every result table and both models under an output folder, so
the report queries read stored tables, not the training lineage.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.config import Params
from churnwise.operators import actions, boosting, clv, evaluation, explain, ml, segments
from churnwise.plans.resume import Run
from churnwise.session import cut_lineage, drop_stages, ensure_checkpoint_dir, path_exists

CUST = "customer_unique_id"
#: Rows a task of a K-Means round holds: all starts of all k pass over them, so a task has more work a row than one of a tree.
KMEANS_ROWS = 50_000


def model_dir(spark, name: str, out_dir: str | None = None) -> str:
    """Where a model is saved: under the run's result folder, or beside the session's checkpoints without one."""
    return f"{(out_dir or ensure_checkpoint_dir(spark)).rstrip('/')}/models/{name}"


def load_churn_model(spark, out_dir: str | None = None):
    """The churn classifier saved by a run with this result folder: feature order, clean-up and run time come with it."""
    return boosting.load(spark, model_dir(spark, "churn", out_dir))


def load_clv_model(spark, out_dir: str | None = None):
    """The value regressor saved by a run with this result folder."""
    return boosting.load(spark, model_dir(spark, "clv", out_dir))


def scaled_stage(feat: DataFrame) -> DataFrame:
    """M1 written once, laid out by its own size, and cached: every K-Means start reads the same blocks."""
    scaled = cut_lineage(ml.scale_rfm(feat.select(CUST, *ml.RFM)), "rfm_scaled")
    return ml.training_layout(scaled, per_partition=KMEANS_ROWS).persist()


def run_segments(feat: DataFrame, params: Params = Params(), sweep: bool = True) -> dict:
    """R2: K-Means with k clusters (best of its starts), named segments, summary; with ``sweep`` every k is reported."""
    scaled = scaled_stage(feat)
    ks = sorted(set(params.k_sweep if sweep else ()) | {params.n_clusters})
    models = ml.best_kmeans(scaled, ks, params.n_init, params.seed)
    customers, named, _ = ml.kmeans_segments(feat, params, models, scaled)
    customers = cut_lineage(customers, "segments")
    out = {"customers": customers, "clusters": named, "segment_summary": segments.segment_summary(customers),
           "kmeans": models[params.n_clusters]}
    if sweep:
        out["k_sweep"] = ml.k_sweep(scaled, {k: m for k, m in models.items() if k in params.k_sweep}, params.silhouette_every)
    scaled.unpersist()
    return out


def run_sweep(feat: DataFrame, params: Params = Params()) -> DataFrame:
    """M2: the k sweep alone."""
    scaled = scaled_stage(feat)
    out = ml.k_sweep(scaled, ml.best_kmeans(scaled, sorted(params.k_sweep), params.n_init, params.seed), params.silhouette_every)
    scaled.unpersist()
    return out


def fit_churn(feat: DataFrame, params: Params = Params()) -> dict:
    """R3, first part: split, weighted boosted trees, held-out metrics and baselines."""
    model, test_scored, train, test = ml.train_churn(feat, params)
    return {"model": model, "test_scored": test_scored, "train": train, "test": test,
            "metrics": ml.churn_metrics(test_scored),
            "confusion": evaluation.confusion_counts(test_scored),
            "classification_report": evaluation.classification_report(test_scored),
            "error_analysis": evaluation.error_analysis(test_scored)}


def score_churn(model, customers: DataFrame, params: Params = Params()) -> DataFrame:
    """Probability and class of every customer, value percentile, action."""
    scored = ml.score_churn(model, ml.assemble(customers)).drop("features")
    return cut_lineage(actions.add_action(actions.add_monetary_percentile(scored, params.rank_buckets)), "churn_scored")


def _facts(df: DataFrame, as_of) -> dict:
    """What a saved model tells of its run: the run time, if there is one."""
    if as_of is None:
        return {}
    return {"last_trained": df.sparkSession.range(1).select(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")).first()[0]}


def explain_churn(model, customers: DataFrame, params: Params = Params(), out_dir: str | None = None, as_of=None) -> DataFrame:
    """Contributions of every feature for every customer (the model is saved on the way, S6)."""
    spark = customers.sparkSession
    model.save(spark, model_dir(spark, "churn", out_dir), _facts(customers, as_of))
    trees = model.explained()
    feats = customers.select(CUST, *[ml.finite_or_zero(c).alias(c) for c in params.feature_cols])
    return cut_lineage(explain.contributions(feats, trees, params.feature_cols), "contributions")


def run_churn(customers: DataFrame, params: Params = Params(), fitted: dict | None = None, out_dir: str | None = None, as_of=None) -> dict:
    """Fit (unless ``fitted``), score all customers, explain them."""
    fit = fitted or fit_churn(customers, params)
    scored = score_churn(fit["model"], customers, params)
    contrib = explain_churn(fit["model"], customers, params, out_dir, as_of)
    return {**fit, "customers": scored, "contributions": contrib,
            "baselines": fit["baselines"] if "baselines" in fit else ml.baselines(fit["train"], fit["test"], fit["test_scored"]),
            "feature_importance": explain.feature_importance(contrib, params.feature_cols),
            "top_reasons": explain.top_reasons(scored, contrib, params.explain_top_n, params.feature_cols)}


def fit_clv(feat: DataFrame, params: Params = Params()) -> dict:
    """R4, first part: plain split, boosted regressor, held-out metrics."""
    model, test = ml.train_clv(feat, params)
    test_scored = cut_lineage(ml.score_clv(model, test).drop("features"), "clv_test")
    return {"model": model, "test_scored": test_scored, "metrics": evaluation.regression_metrics(test_scored)}


def run_clv(customers: DataFrame, params: Params = Params(), fitted: dict | None = None, out_dir: str | None = None, as_of=None) -> dict:
    """Fit (unless ``fitted``), predicted value and tier of every customer."""
    fit = fitted or fit_clv(customers, params)
    fit["model"].save(customers.sparkSession, model_dir(customers.sparkSession, "clv", out_dir), _facts(customers, as_of))   # S7
    scored = cut_lineage(ml.score_clv(fit["model"], ml.assemble(customers)).drop("features"), "clv_scored")
    tiers = cut_lineage(clv.add_clv_tier(scored, buckets=params.rank_buckets), "clv_tiers")
    return {**fit, "customers": tiers, "thresholds": clv.clv_thresholds(tiers, buckets=params.rank_buckets)}


def run_activation(customers: DataFrame, as_of, params: Params = Params()) -> dict:
    """Rule-based activation events and their summary."""
    ev = actions.activation_events(customers, as_of, params.churn_threshold, params.clv_threshold)
    return {"events": ev,
            "summary": actions.activation_summary(customers, params.churn_threshold, params.clv_threshold)}


def run_all(feat: DataFrame, as_of, params: Params = Params(), out_dir: str | None = None,
            clean_up: bool = False) -> dict:
    """Segments -> churn -> value -> activation; optionally every table and
    both models written under ``out_dir`` (the serving layer reads those).

    With ``out_dir`` every stage is stored under the key of its inputs, so a
    run that broke off continues after its last finished stage.  ``clean_up``
    deletes the session's stage tables and the run's stages at the end and
    returns the stored tables instead."""
    run = Run(feat.sparkSession, feat, as_of, params, out_dir)

    def only(found, *names):
        return {k: found[k] for k in names}

    def churn_fit():
        fit = fit_churn(feat, params)
        return {**only(fit, "model", "metrics", "confusion", "classification_report", "error_analysis"),
                "baselines": ml.baselines(fit["train"], fit["test"], fit["test_scored"])}
    # the three fits only need the feature stage: submit them together so
    # their many small iteration jobs share the executors
    with ThreadPoolExecutor(max_workers=3) as ex:
        f_seg = ex.submit(run.stage, "segments", lambda: only(run_segments(feat, params), "customers", "segment_summary", "k_sweep"))
        f_churn = ex.submit(run.stage, "churn_fit", churn_fit)
        f_clv = ex.submit(run.stage, "clv_fit", lambda: only(fit_clv(feat, params), "model", "metrics"))
        seg, churn, value = f_seg.result(), f_churn.result(), f_clv.result()
    ch = run.stage("churn", lambda: only(run_churn(seg["customers"], params, churn, out_dir, as_of), "customers", "metrics", "confusion",
                                         "classification_report", "error_analysis", "baselines", "feature_importance", "top_reasons"))
    cl = run.stage("clv", lambda: only(run_clv(ch["customers"], params, value, out_dir, as_of), "customers", "metrics", "thresholds"))
    act = run_activation(cl["customers"], as_of, params)
    res = {
        "customers": cl["customers"], "segment_summary": seg["segment_summary"], "k_sweep": seg["k_sweep"],
        "churn_metrics": ch["metrics"], "confusion": ch["confusion"],
        "classification_report": ch["classification_report"], "error_analysis": ch["error_analysis"],
        "baselines": ch["baselines"], "feature_importance": ch["feature_importance"],
        "top_reasons": ch["top_reasons"], "clv_metrics": cl["metrics"], "clv_thresholds": cl["thresholds"],
        "activation_events": act["events"], "activation_summary": act["summary"],
    }
    if out_dir:
        base, spark = out_dir.rstrip("/"), feat.sparkSession
        for name, df in res.items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        status(res["customers"], as_of, out_dir).write.mode("overwrite").parquet(f"{base}/status")
        if clean_up:
            drop_stages(spark)
            run.forget()
            return {name: spark.read.parquet(f"{base}/{name}") for name in res}
    return res


def status(customers: DataFrame, as_of=None, out_dir: str | None = None) -> DataFrame:
    """Customers in the result, whether the churn model is saved, and the run time saved with it (``as_of`` where it has none)."""
    spark = customers.sparkSession
    at = model_dir(spark, "churn", out_dir)
    loaded = path_exists(spark, at + "/metadata/_SUCCESS")
    trained = boosting.load_metadata(spark, at)["info"].get("last_trained") if loaded else None
    if trained is not None:
        time = F.lit(trained)
    else:
        time = F.lit(None).cast("string") if as_of is None else F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")
    return customers.agg(F.count(F.lit(1)).alias("total_customers")).select(
        F.lit(loaded).alias("model_loaded"), time.alias("last_trained"), "total_customers")
