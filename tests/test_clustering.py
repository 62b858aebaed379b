"""Shared-scan K-Means against a plain Lloyd run and Spark's own fits."""
import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from churnwise.operators import clustering as C


def points(spark, x, parts=3):
    rows = [(f"c{i}", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "customer_unique_id string, a array<double>").select("customer_unique_id", array_to_vector("a").alias("rfm_scaled")).repartition(parts)


def test_costs_and_fixed_points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.7, (120, 3)) for c in ([0, 0, 0], [4, 0, 1], [0, 5, 2], [3, 3, -4], [-4, 1, 1])])
    df = points(spark, x).persist()
    best = C.fit_all(df, [2, 4, 5], 6, 42)
    for k, m in best.items():
        d = ((x[:, None, :] - m.centres[None]) ** 2).sum(axis=2)
        assert abs(d.min(axis=1).sum() - m.cost) < 1e-6 * m.cost
        near = d.argmin(axis=1)                                    # every centre is the mean of its members
        assert all(np.abs(x[near == j].mean(axis=0) - m.centres[j]).max() < 1e-3 for j in range(k))
        got = {r.customer_unique_id: r.cluster for r in m.transform(df).collect()}
        assert [got[f"c{i}"] for i in range(len(x))] == near.tolist()
        spark_best = min(KMeans(k=k, seed=s, featuresCol="rfm_scaled").fit(df).summary.trainingCost for s in range(3))
        assert m.cost <= spark_best * 1.001
    again = C.fit_all(points(spark, x, 7), [2, 4, 5], 6, 42)         # another layout, the same centres
    assert all(np.allclose(again[k].centres, best[k].centres, atol=1e-9) for k in best)
    df.unpersist()


def test_odd_points(spark):
    same = C.fit_all(points(spark, [[1.0, 2.0, 3.0]] * 5), [3], 2, 1)[3]
    assert same.cost == 0 and same.centres.shape == (3, 3)
    assert C.fit_all(points(spark, [[1.0, 2.0, 3.0]]).limit(0), [2], 1, 1) == {}
