"""TreeSHAP vs exact Shapley values of the path-dependent tree expectation."""
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from churnwise.operators import explain


def _exp_value(t, x, subset, node=0):
    if t["left"][node] < 0:
        return t["value"][node]
    f = t["feature"][node]
    l, r = t["left"][node], t["right"][node]
    if f in subset:
        return _exp_value(t, x, subset, l if x[f] <= t["threshold"][node] else r)
    c = t["cover"][node]
    return (t["cover"][l] * _exp_value(t, x, subset, l) + t["cover"][r] * _exp_value(t, x, subset, r)) / c


def _brute(trees, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for s in itertools.combinations(others, k):
                wt = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                for t in trees:
                    phi[i] += 2 * t["weight"] * wt * (_exp_value(t, x, set(s) | {i}) - _exp_value(t, x, set(s)))
    return phi


def test_tree_shap_exact_and_additive(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)).round(3)
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=300)) > 0).astype(float)
    df = spark.createDataFrame([(f"c{i}", *map(float, r), float(l)) for i, (r, l) in enumerate(zip(x, y))],
                               "customer_unique_id string, a double, b double, c double, label double")
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(v)
    trees = explain.load_trees(spark, model, str(tmp_path / "gbt"))
    batch = x[:12]
    phi = np.zeros_like(batch)
    for t in trees:
        explain._tree_shap(t, batch, phi)
    for row, p in zip(batch, phi):
        assert np.allclose(p, _brute(trees, row, 3), atol=1e-9)
    # additivity: base + sum(contributions) equals the model's log-odds 2 * margin
    contrib = explain.contributions(df, trees, ["a", "b", "c"]).toPandas().set_index("customer_unique_id")
    raw = model.transform(v).select("customer_unique_id", F.col("rawPrediction")).toPandas()
    margin = raw.set_index("customer_unique_id")["rawPrediction"].map(lambda r: 2 * r[1])
    assert np.allclose(contrib.loc[margin.index, "margin"], margin, atol=1e-9)


def _grown(rng, depth, n_features, p=0.9):
    t = {c: [] for c in ("left", "right", "feature", "threshold", "cover", "value")}

    def add(cover, level):
        node = len(t["left"])
        for c, v in (("left", -1), ("right", -1), ("feature", -1), ("threshold", np.nan), ("cover", cover), ("value", rng.normal())):
            t[c].append(v)
        if level < depth and (level < 2 or rng.random() < p):
            first = cover * rng.uniform(0.05, 0.95)
            t["feature"][node], t["threshold"][node] = int(rng.integers(n_features)), rng.normal()
            t["left"][node], t["right"][node] = add(first, level + 1), add(cover - first, level + 1)
        return node
    add(1000.0, 0)
    return {**{c: np.array(v) for c, v in t.items()}, "depth": depth, "weight": 0.5}


def test_tables_repeat_the_recursion(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 6)).round(1)
    for depth in (0, 1, 4, 6, explain.TABLE_DEPTH + 1):                # features repeat on the paths; the last goes through the recursion
        t = _grown(rng, depth, 6)
        want, got = np.zeros_like(x), np.zeros_like(x.T)
        explain._tree_shap(t, x, want)
        explain._add_contributions(t, np.ascontiguousarray(x.T), got)
        assert np.allclose(got.T, want, atol=1e-12)
    # trees of the model's depth are looked up, not walked again for every batch
    t = _grown(rng, 6, 6)
    monkeypatch.setattr(explain, "_tree_shap", None)
    frame = pd.DataFrame({"customer_unique_id": [f"c{i}" for i in range(500)], **{f"f{j}": x[:, j] for j in range(6)}})
    got = pd.concat(explain.contributions_fn([t], [f"f{j}" for j in range(6)])([frame[:300], frame[300:]]))
    reached = [_exp_value(t, r, set(range(6))) for r in x]
    assert np.allclose(got["margin"], reached)
