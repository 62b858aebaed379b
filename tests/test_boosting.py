"""Second-order trees against a plain recomputation of every split, and their storage."""
import pickle

import numpy as np
import pytest
from pyspark import RDD

from churnwise.operators import boosting as B, explain


def table(spark, x, y, w, parts):
    rows = [(f"c{i}", *map(float, r), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "customer_unique_id string, a double, b double, c double, label double, weight double").repartition(parts)


def recomputed(x, cuts, g, h, rows, used, depth, limit=6):
    """The tree over ``rows`` by trying every cut: nested (feature, threshold, left, right) or a leaf value."""
    best = None
    if depth < limit:
        G, H = g[rows].sum(), h[rows].sum()
        for f in used:
            for t in cuts[f]:
                left = rows[x[rows, f] <= t]
                right = rows[x[rows, f] > t]
                if h[left].sum() < B.MIN_CHILD or h[right].sum() < B.MIN_CHILD:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - G * G / (H + 1)
                if gain > B.MIN_GAIN and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, t, left, right)
    if best is None:
        return -0.1 * g[rows].sum() / (h[rows].sum() + 1)
    _, f, t, left, right = best
    return (f, t, recomputed(x, cuts, g, h, left, used, depth + 1, limit), recomputed(x, cuts, g, h, right, used, depth + 1, limit))


def nested(t, node=0):
    if t["feature"][node] < 0:
        return t["value"][node]
    return (t["feature"][node], t["threshold"][node], nested(t, t["left"][node]), nested(t, t["right"][node]))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3]) if isinstance(a, tuple) else abs(a - b) < 1e-9


@pytest.mark.parametrize("objective", ["logistic", "squared"])
def test_every_split(spark, objective, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(160, 3)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.2).astype(float) if objective == "logistic" else (10 * x[:, 0] + 5 * np.abs(x[:, 1])).round(2)
    w = np.where(y > 0.5, 1.5, 1.0) if objective == "logistic" else np.ones(160)
    df = table(spark, x, y, w, 3)
    model = B.fit(df, ["a", "b", "c"], "label", objective, weight="weight", n_trees=3, max_depth=3, row_sample=1.0, feature_sample=0.67)
    cuts = [np.unique(x[:, f])[:-1] for f in range(3)]
    margin, draws = np.full(160, model.base), np.random.default_rng(42)
    for t in model.trees:
        used = np.sort(draws.choice(3, 2, replace=False))
        g, h = B.gradients(objective, margin, y, w)
        assert same(nested(t), recomputed(x, cuts, g, h, np.arange(160), used, 0, 3))
        margin += t["value"][B.descend(t, x.T, "threshold")]
    assert np.allclose(model.margins(x), margin)
    got = {r.customer_unique_id: r.m for r in df.select("customer_unique_id", model.margin().alias("m")).collect()}
    assert np.allclose([got[f"c{i}"] for i in range(160)], margin)
    # stored and loaded again, from the folder alone
    model.save(spark, str(tmp_path / "m"), {"last_trained": "2024-01-01T00:00:00"})
    back = B.load(spark, str(tmp_path / "m"))
    assert back.features == ["a", "b", "c"] and back.info == {"rows": 160, "last_trained": "2024-01-01T00:00:00"} and np.array_equal(back.margins(x), model.margins(x))
    # contributions add up to the margin
    phi, trees = np.zeros((160, 3)), model.explained()
    for t in trees:
        explain._tree_shap(t, x, phi)
    assert np.allclose(phi.sum(axis=1) + 2 * explain.expected_margin(trees), margin)


def test_layout_and_samples(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(900, 3)), rng.integers(0, 2, 900)
    fits = [B.fit(table(spark, x, y, np.ones(900), parts), ["a", "b", "c"], "label", n_trees=4, max_depth=4) for parts in (1, 5, 20)]
    assert all(np.allclose(f.margins(x), fits[0].margins(x), atol=1e-9) for f in fits)
    key = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    takes = [B.sampled(key, 42, t, 0.8) for t in range(3)]
    assert all(abs(t.mean() - 0.8) < 0.02 for t in takes) and (takes[0] != takes[1]).mean() > 0.2
    empty = B.fit(table(spark, x, y, np.ones(900), 1).limit(0), ["a", "b", "c"], "label", n_trees=2)
    assert empty.trees == [] and empty.margins(x).tolist() == [0.0] * 900


def test_only_splits_reach_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(700, 3)), rng.integers(0, 2, 700)
    sent, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: (lambda rows: (sent.append(len(pickle.dumps(rows))), rows)[1])(collect(self)))
    model = B.fit(table(spark, x, y, np.ones(700), 20), ["a", "b", "c"], "label", n_trees=2, max_depth=4)
    assert max(t["depth"] for t in model.trees) == 4
    # a histogram of one node alone holds 3 features x 256 bins x 16 bytes
    assert sent and max(sent) < 8 * 1000


def test_sums_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(B, "MERGE", 3)
    rng = np.random.default_rng(5)
    a = rng.normal(size=(11, 4, 6)) * 10.0 ** rng.integers(-9, 9, (11, 4, 6))
    pieces = spark.sparkContext.parallelize([((i, s), a[i, s]) for i in range(11) for s in range(4)], 11)
    got = B._per_node(pieces, 11, 4, lambda v: v)
    level = list(a)
    while len(level) > 1:
        level = [sum(level[lo: lo + 3]) for lo in range(0, len(level), 3)]
    assert sorted(got) == [0, 1, 2, 3] and all(np.array_equal(got[s], level[0][s]) for s in range(4))


def test_rows_go_down_trees_of_any_shape(monkeypatch):
    monkeypatch.setattr(B, "DESCEND_ROWS", 7)
    rng = np.random.default_rng(6)
    for depth in (0, 1, 5):
        t = {c: [] for c in ("feature", "left", "right", "bin", "threshold")}

        def add(level):
            node = len(t["left"])
            for c, v in (("feature", -1), ("left", -1), ("right", -1), ("bin", 0), ("threshold", np.nan)):
                t[c].append(v)
            if level < depth and (not level or rng.random() < 0.7):
                t["feature"][node], t["bin"][node], t["threshold"][node] = int(rng.integers(3)), int(rng.integers(250)), rng.normal()
                t["left"][node], t["right"][node] = add(level + 1), add(level + 1)
            return node
        add(0)
        tree = {**{c: np.array(v) for c, v in t.items()}, "depth": depth}
        for x, cut in ((rng.integers(0, 256, (3, 40)).astype(np.uint8), "bin"), (rng.normal(size=(40, 3)).T, "threshold"), (np.zeros((3, 0)), "threshold")):
            want = []
            for row in x.T:
                at = 0
                while tree["feature"][at] >= 0:
                    at = tree["right" if row[tree["feature"][at]] > tree[cut][at] else "left"][at]
                want.append(at)
            assert B.descend(tree, x, cut).tolist() == want
