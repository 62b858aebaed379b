"""A run that broke off continues after its last finished stage."""
import pytest
from pyspark.sql import functions as F

from datadirs import SF001
from churnwise.config import Params
from churnwise.operators import ml
from churnwise.plans import batch, models, resume
from churnwise.sources.testdata import load_test_tables

FAST = Params(n_trees=3, n_init=2, k_sweep=(3, 4))


def test_a_rerun_continues_after_the_last_stage(spark, tmp_path, monkeypatch):
    clean = batch.order_stage(load_test_tables(spark, SF001))
    feat, as_of, out = batch.feature_stage(clean), batch.run_time(clean), str(tmp_path / "run")
    calls = {"churn": 0, "clv": 0, "kmeans": 0}

    def counted(name, fn):
        def run(*a, **k):
            calls[name] += 1
            return fn(*a, **k)
        return run
    monkeypatch.setattr(ml, "train_churn", counted("churn", ml.train_churn))
    monkeypatch.setattr(ml, "train_clv", counted("clv", ml.train_clv))
    monkeypatch.setattr(ml, "best_kmeans", counted("kmeans", ml.best_kmeans))
    whole = models.run_clv

    def stops(*a, **k):
        raise RuntimeError("stopped")
    monkeypatch.setattr(models, "run_clv", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        models.run_all(feat, as_of, FAST, out_dir=out)
    assert calls == {"churn": 1, "clv": 1, "kmeans": 1}
    monkeypatch.setattr(models, "run_clv", whole)
    res = models.run_all(feat, as_of, FAST, out_dir=out)
    assert calls == {"churn": 1, "clv": 1, "kmeans": 1}          # no fit was made again
    assert res["customers"].count() == feat.count()
    assert models.load_churn_model(spark, out).numFeatures == len(FAST.feature_cols)
    # other parameters or other rows are another run
    models.run_all(feat, as_of, Params(n_trees=2, n_init=2, k_sweep=(3, 4)), out_dir=out)
    assert calls["churn"] == 2


def test_unfinished_stage_is_made_again(spark, tmp_path):
    feat = spark.range(5)
    made = []

    def make():
        made.append(1)
        return {"a": spark.range(3), "b": spark.range(4).withColumn("x", F.raise_error(F.lit("broken")) if len(made) == 1 else F.lit("1"))}
    run = resume.Run(spark, feat, None, FAST, str(tmp_path))
    with pytest.raises(Exception, match="broken"):
        run.stage("s", make)
    assert run.stage("s", make)["b"].count() == 4 and len(made) == 2
    again = resume.Run(spark, feat.repartition(3), None, FAST, str(tmp_path))
    assert again.stage("s", make)["a"].count() == 3 and len(made) == 2
    other = resume.Run(spark, spark.range(6), None, FAST, str(tmp_path))
    other.stage("s", make)
    assert len(made) == 3
    run.forget()
    resume.Run(spark, feat, None, FAST, str(tmp_path)).stage("s", make)
    assert len(made) == 4


def test_fingerprint_counts_repeated_rows(spark):
    one = spark.range(4)
    assert resume.fingerprint(one) == resume.fingerprint(one.repartition(3))
    assert resume.fingerprint(one) != resume.fingerprint(one.unionAll(one))
    assert resume.fingerprint(one.limit(0)) != resume.fingerprint(one)


def test_stage_writes_leave_the_shuffle_setting_alone(spark):
    from churnwise import session
    before = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    a = session.cut_lineage(spark.range(100).repartition(4).groupBy((F.col("id") % 7).alias("k")).count(), "one")
    assert a.count() == 7 and spark.conf.get(session.SHUFFLE_CLEANUP, None) == before
    session.drop_stage(a)
    with pytest.raises(Exception):
        spark.read.parquet(a.inputFiles()[0]).count()
