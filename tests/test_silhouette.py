"""Euclidean silhouettes against their definition."""
import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector

from churnwise.operators import silhouette as S


def by_definition(x, label):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = (label == label[i]).sum() - 1
        others = [d[i, label == c].mean() for c in set(label.tolist()) - {label[i]}]
        if not own or not others:
            out.append(0.0)
            continue
        a, b = d[i, label == label[i]].sum() / own, min(others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


def frame(spark, x, labels):
    rows = [([float(v) for v in r], *[int(l[i]) for l in labels]) for i, r in enumerate(x)]
    names = [f"c{j}" for j in range(len(labels))]
    return (spark.createDataFrame(rows, "a array<double>, " + ", ".join(f"{n} int" for n in names))
            .select(array_to_vector("a").alias("rfm_scaled"), *names).repartition(3))


def test_every_point_of_every_clustering(spark, monkeypatch):
    monkeypatch.setattr(S, "STRIPE_ROWS", 60)                 # several stripes
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (70, 3)) for c in ([0, 0, 0], [3, 0, 1], [0, 4, 2])])
    x = np.concatenate([x, np.repeat(x[:1], 90, axis=0), [[50.0, 50.0, 50.0]]])        # a hot point and a lone one
    two = (x[:, 0] > 1.5).astype(int)
    four = np.where(x[:, 0] > 40, 3, np.where(x[:, 1] > 2, 2, two))
    six = four.copy()                                          # clusters 4 and 5 stay empty
    got = S.silhouettes(frame(spark, x, [two, four, six]), {2: "c0", 4: "c1", 6: "c2"})
    for k, label in ((2, two), (4, four), (6, six)):
        assert abs(got[k] - by_definition(x, label).mean()) < 1e-9


def test_odd_tables(spark):
    same = frame(spark, [[1.0, 2.0, 3.0]] * 5, [[0] * 5])
    assert S.silhouettes(same, {2: "c0"}) == {2: 0.0}
    assert S.silhouettes(same.limit(0), {2: "c0"}) == {2: 0.0}
    negative_zero = frame(spark, [[0.0, 1.0, 1.0], [-0.0, 1.0, 1.0], [5.0, 1.0, 1.0], [5.0, 2.0, 1.0]], [[0, 0, 1, 1]])
    want = by_definition(np.array([[0, 1, 1], [0, 1, 1], [5, 1, 1], [5, 2, 1.0]]), np.array([0, 0, 1, 1])).mean()
    assert abs(S.silhouettes(negative_zero, {2: "c0"})[2] - want) < 1e-12


def test_share_of_the_points_against_all(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (600, 3))
    label = (x[:, 0] > 0).astype(int)
    df = frame(spark, x, [label])
    part = S.silhouettes(df, {2: "c0"}, every=3)[2]
    assert abs(part - by_definition(x, label).mean()) < 0.05


def test_each_pair_is_computed_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 3)).round(1)
    x = np.concatenate([x, x[:40], x[:40]])                    # repeated points
    labels = [(x[:, 0] > 0).astype(int), np.digitize(x[:, 1], [-1, 0, 1]), rng.integers(0, 2, 1)[0] + np.zeros(len(x), int)]
    want = [by_definition(x, l) for l in labels]
    for rows, most, stripes, block, tile in ((40, 80, 3, 4, 16), (50, 1000, 32, 3, 64), (1000, 2000, 32, 16, 8192)):
        for name, value in (("STRIPE_ROWS", rows), ("MOST_ROWS", most), ("MAX_STRIPES", stripes), ("BLOCK", block), ("TILE", tile)):
            monkeypatch.setattr(S, name, value)
        got = S.silhouettes(frame(spark, x, labels), {2: "c0", 4: "c1", 3: "c2"})
        assert all(abs(got[k] - w.mean()) < 1e-9 for k, w in zip((2, 4, 3), want))
    # a pair of stripes gives the sums of both its ends
    n, ks = np.arange(1, 10), [2, 3]
    table = pa.table({"a": rng.normal(size=9), "b": rng.normal(size=9), "n": n, "k2": n % 2, "k3": n % 3, "stripe": n % 2, "scored": np.ones(9, bool)})
    out = S._distance_sums(table, ["a", "b"], ["k2", "k3"], ks).to_pandas().set_index(["a", "b"])
    t = table.to_pandas()
    assert len(out) == 9
    for r in t.itertuples():
        other = t[t.stripe != r.stripe]
        d = other.n * np.hypot(other.a - r.a, other.b - r.b)
        assert np.allclose(out.loc[(r.a, r.b)], [d[other.k2 == 0].sum(), d[other.k2 == 1].sum(), *[d[other.k3 == j].sum() for j in range(3)]])
