import math

import numpy as np
import pytest

from churnwise.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, v string, node string, block string"


def brute(rows):
    ok = [(i, v, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(ok)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = [0] * len(ok)
    for i in range(len(ok)):
        for j in range(i):
            a, b = ok[i][2], ok[j][2]
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (vec, _, _) in enumerate(ok):
        least[root(i)] = min(least.get(root(i), vec), vec)
    out = [(vec, links[i], least[root(i)], vec == least[root(i)]) for i, (vec, _, _) in enumerate(ok)]
    bad = {id(v) for _, v, _ in ok}
    out += [(i, 0, i, True) for i, v in rows if id(v) not in bad]
    return sorted(out)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], SCHEMA).repartition(parts)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())


def as_float32(v):
    return [float(np.float32(x)) for x in v]


def test_clusters_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 20)                      # many blocks, shells and centres
    rng = np.random.default_rng(2)
    rows = []
    for c in range(8):                                       # tight, middling and loose clusters
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append(as_float32(centre + rng.normal(size=16) * (0.005, 0.05, 0.25, 0.4)[c % 4]))
    rows += [as_float32(rng.normal(size=16)) for _ in range(60)]
    rows += [list(rows[0]) for _ in range(30)]               # copies
    rows = list(enumerate(rows))
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0]), (12, [3e38, 1e38]), (13, [3.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_repeated_ids_are_rows_of_their_own(spark):
    assert run(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0])]) == [(1, 1, 1, True)] * 2


@pytest.mark.parametrize("reach", [0.05, 0.3, 1.0])
def test_traversal_loses_no_pair(reach):
    import pandas as pd
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = E.CoverTree(x[:100], 30)
    for i, p in enumerate(tree.parent[1:], 1):               # levels nest and cover
        assert np.linalg.norm(tree.points[i] - tree.points[p]) <= 2 * 2.0 ** (1 - tree.level[p]) + 1e-9
        assert tree.level[p] < tree.level[i]
    leaf, d = tree.nearest(x)
    blocks = pd.DataFrame({"leaf": leaf, "d": d}).groupby("leaf").d.agg(low="min", high="max").reset_index()
    blocks["block"] = blocks.index
    block = blocks.set_index("leaf").block.to_dict()
    compare, whole = tree.traverse(blocks, reach)
    seen, all_of = {tuple(sorted(p)) for p in compare}, {tuple(sorted(p)) for p in whole}
    assert len(seen) == len(compare) and not seen & all_of
    far = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    for i in range(len(x)):
        for j in range(i):
            pair = tuple(sorted((block[leaf[i]], block[leaf[j]])))
            if far[i, j] <= reach:
                assert pair in seen or pair in all_of
            elif pair in all_of:
                raise AssertionError("a pair beyond the threshold was taken whole")


def clustered(rng, n=160):
    centres = rng.normal(size=(6, 12))
    return list(enumerate(as_float32(centres[i % 6] + rng.normal(size=12) * (0.02, 0.1, 0.3)[i % 3]) for i in range(n)))


def test_rounds_move_a_bounded_share_of_the_vectors(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("TILE_BYTES", 3 * 8 * 12 * 8), ("TILES", 2), ("ROUND", 0.5), ("ROUND_BYTES", 0)):
        monkeypatch.setattr(E, name, value)
    rows = clustered(np.random.default_rng(5))
    moved, compare = [], E._rounds

    def rounds(rows, held, cells, *more):
        tiles = [held[b].sum() for _, b in cells]
        for df in compare(rows, held, cells, *more):
            moved.append(1)
            yield df
        assert len(moved) >= sum(tiles) / (E.ROUND * held.sum()) > 2                # more than two rounds move
    monkeypatch.setattr(E, "_rounds", rounds)
    assert run(spark, rows) == brute(rows)
    assert len(moved) > 2


def test_pairs_fall_into_cells_once():
    rng = np.random.default_rng(6)
    x, y = np.nonzero(np.triu(rng.random((50, 50)) < 0.4))
    pairs = np.stack([x, y], axis=1)
    cells = E._cells(pairs, 50, E.TILE_BYTES // 3)
    assert sorted(map(tuple, np.concatenate([p for p, _ in cells]).tolist())) == sorted(map(tuple, pairs.tolist()))
    assert all(set(p.ravel().tolist()) == set(b.tolist()) and len(b) <= 6 for p, b in cells)


def test_single_precision_loses_no_pair():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 20))
    x[150:] = x[:150] + rng.normal(size=(150, 20)) * 0.33           # many pairs about the threshold
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cosine in (0.95, float(x[0] @ x[150]), -1.0):
        i, j = E._near(x, x.astype(np.float32), slice(10, 290), slice(0, 300), cosine - 1e-12)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= cosine - 1e-12)) if 10 <= a < 290}


def test_vectors_that_share_their_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows = [*clustered(np.random.default_rng(8), 30), (100, [0.0] * 11 + [1.0]), (101, [-0.0] * 11 + [1.0]), (102, None)]
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(E, "_hashes", lambda v: [F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2")])
    assert run(spark, rows) == want


def test_double_vectors_keep_their_digits(spark):
    near = [1.0, 1e-12]
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, near), (3, near), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    out = sorted(tuple(r) for r in E.near_duplicates(df).collect())
    assert out == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
