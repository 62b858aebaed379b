"""Model stages checked by bounds and structure, never by exact value."""
from pyspark.sql import functions as F

from datadirs import SF001
from churnwise.config import Params
from churnwise.operators import ml
from churnwise.plans import batch, models
from churnwise.sources.testdata import load_test_tables

FAST = Params(n_trees=5, n_init=2, k_sweep=(2, 3, 4))


def test_split_is_exact_and_stratified(spark):
    feat = batch.run_data(load_test_tables(spark, SF001))
    s = ml.split_flag(feat, 0.2, 42, "churned").groupBy("churned").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()
    for r in s:
        assert r.t == -(-r.n * 2 // 10)          # ceil(0.2 * n) per class


def test_run_all_shapes(spark, tmp_path):
    t = load_test_tables(spark, SF001)
    clean = batch.order_stage(t)
    feat = batch.feature_stage(clean)
    out = str(tmp_path / "results")
    # a session that has observed a run can still run and store the models
    batch.run_data(t, audit={})
    res = models.run_all(feat, batch.run_time(clean), FAST, out_dir=out)
    cust = res["customers"]
    n = feat.count()
    assert cust.count() == n
    segs = {r.segment for r in cust.select("segment").distinct().collect()}
    assert segs <= {"Champions", "Loyalists", "At-Risk", "Hibernating"} and len(segs) == 4
    b = cust.agg(F.min("churn_probability"), F.max("churn_probability"), F.min("predicted_clv")).collect()[0]
    assert 0 <= b[0] <= b[1] <= 1 and b[2] >= 0
    assert res["k_sweep"].count() == 3
    assert res["feature_importance"].count() == len(FAST.feature_cols)
    reasons = res["top_reasons"]
    assert reasons.groupBy("customer_unique_id").count().filter("count != 3").count() == 0
    assert res["activation_summary"].collect()[0].total_evaluated == n
    # saved models load back and score the same
    from pyspark.sql import functions as G
    m = models.load_churn_model(spark, out)
    again = ml.score_churn(m, ml.assemble(cust.drop("churn_probability", "churn_prediction", "churn_score")))
    diff = again.join(cust.select("customer_unique_id", G.col("churn_probability").alias("p0")), "customer_unique_id")
    assert diff.filter(G.col("churn_probability") != G.col("p0")).count() == 0
    assert models.load_clv_model(spark, out).numFeatures == len(FAST.feature_cols)
    # serving views over the same results
    from churnwise.plans import serving
    d = serving.dashboard_stats(cust, res["churn_metrics"], res["clv_metrics"]).collect()
    assert len(d) == 1 and d[0].total_customers == n and 0 <= d[0].roc_auc <= 1
    # no customer's reasons are cut, even where many share the risk
    shown = serving.churn_risk_view(res, n=20)["top_high_risk_users"].groupBy("customer_unique_id").count().collect()
    assert len(shown) == 20 and all(r["count"] == 3 for r in shown)
    for view in (serving.segments_view, serving.churn_risk_view, serving.action_matrix_view,
                 serving.clv_view, serving.activations_view):
        for name, df in view(res).items():
            assert df.count() >= 0, name
    assert serving.churn_risk_view(res)["churn_distribution"].count() == 50
    stored = serving.read_results(spark, out)
    assert set(serving.TABLES) <= set(stored)
    assert stored["customers"].count() == n and stored["status"].collect()[0].total_customers == n
    assert stored["status"].collect()[0].model_loaded
    assert serving.dashboard_stats(stored["customers"], stored["churn_metrics"],
                                   stored["clv_metrics"]).collect()[0].total_customers == n


def test_auc_is_the_share_of_ordered_pairs(spark):
    rows = [(1, 0.9), (1, 0.5), (1, 0.5), (1, 0.1), (0, 0.5), (0, 0.4), (0, 0.1), (0, 0.1), (0, 0.05)]
    pairs = [(1.0 if p > q else 0.5 if p == q else 0.0) for y, p in rows if y for z, q in rows if not z]
    df = spark.createDataFrame(rows, "churned int, churn_score double")
    assert ml.auc(df).collect()[0].roc_auc == round(sum(pairs) / len(pairs), 4)
    assert ml.auc(df.filter("churned = 1")).collect()[0].roc_auc == 0.5


def test_stage_tables_go(spark):
    import os
    from churnwise import session
    df = session.cut_lineage(spark.range(3), "gone")
    path = df.inputFiles()[0].replace("file://", "").rsplit("/", 1)[0]
    assert os.path.exists(path)
    kept = list(session._STAGES)
    session._STAGES[:] = kept[-1:]                  # this stage alone
    session.drop_stages(spark)
    session._STAGES[:] = kept[:-1]
    assert not os.path.exists(path)
