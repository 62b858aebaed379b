"""Per-customer feature contributions of a boosted-tree model.

Path-dependent TreeSHAP (Lundberg, Erion, Lee 2018, "Consistent
individualized feature attribution for tree ensembles", Algorithm 2) run in
``mapInPandas``.  The recursion visits the same nodes in the same order for
every row; only the "one fractions" (does the row follow this branch) and
the path weights differ, so one traversal handles a whole Arrow batch with
numpy arrays of batch length.

What a leaf gives to the features of its path depends only on which of them
let the row through: a leaf with m of them has 2^m outcomes.  For trees of up
to ``TABLE_DEPTH`` levels these outcomes are computed once per tree and looked up per
row; deeper trees go through the recursion.

The tree table (n_trees x at most 2^(depth+1)-1 nodes) is read from the
saved model and broadcast: its size is bounded by the model parameters, not
by the data.  Contributions are in log-odds: Spark's margin m gives
p = 1 / (1 + exp(-2 m)), so the per-tree values are doubled.
"""

from __future__ import annotations

import math
import os
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise import config
from churnwise.functions.scalar import explanation_text, feature_label, round_half_even

CUST = "customer_unique_id"
#: Deepest trees whose leaves keep a table of outcomes (at most 2^depth leaves x 2^depth outcomes x depth doubles a tree).
TABLE_DEPTH = 7

# ship this module's code with the task closure, so executors need no install
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: rely on an installed package
    pass


def load_trees(spark, model, model_path: str) -> list[dict]:
    """Node arrays per tree from the saved model (bounded size, collected)."""
    model.write().overwrite().save(model_path)
    rows = (spark.read.parquet(os.path.join(model_path, "data"))
            .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
                    "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
                    "nodeData.split.leftCategoriesOrThreshold").collect())
    weights = list(model.treeWeights)
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r.treeID, []).append(r)
    out = []
    for tid in sorted(trees):
        nodes = sorted(trees[tid], key=lambda r: r.id)
        n = len(nodes)
        idx = {r.id: i for i, r in enumerate(nodes)}
        left = np.array([idx.get(r.leftChild, -1) if r.leftChild >= 0 else -1 for r in nodes])
        right = np.array([idx.get(r.rightChild, -1) if r.rightChild >= 0 else -1 for r in nodes])
        depth = np.zeros(n, dtype=int)
        for i in range(n):                       # preorder: parents come before children
            for c in (left[i], right[i]):
                if c >= 0:
                    depth[c] = depth[i] + 1
        out.append({
            "depth": int(depth.max()),
            "weight": float(weights[tid]),
            "value": np.array([r.prediction for r in nodes], dtype=float),
            "cover": np.array([float(r.impurityStats[0]) for r in nodes], dtype=float),
            "left": left, "right": right,
            "feature": np.array([r.featureIndex for r in nodes], dtype=int),
            "threshold": np.array([r.leftCategoriesOrThreshold[0] if r.leftCategoriesOrThreshold
                                   else np.nan for r in nodes], dtype=float),
        })
        assert len(out[-1]["value"]) == n
    return out


def expected_margin(trees: list[dict]) -> float:
    """Cover-weighted mean output of the ensemble (the base value)."""
    total = 0.0
    for t in trees:
        leaves = t["left"] < 0
        total += t["weight"] * float(np.sum(t["value"][leaves] * t["cover"][leaves]) / t["cover"][0])
    return total


def _tree_shap(t: dict, x: np.ndarray, phi: np.ndarray) -> None:
    """Add one tree's contributions for a batch ``x`` (rows x features) to ``phi``."""
    nrow = x.shape[0]
    depth_cap = t["depth"] + 2                    # path slots: root dummy + one per level
    feat = np.full(depth_cap, -1, dtype=int)
    zero = np.zeros(depth_cap)
    one = np.zeros((depth_cap, nrow))
    pw = np.zeros((depth_cap, nrow))
    scale = t["weight"] * 2.0                      # log-odds units

    def extend(d, z, o, f):
        feat[d], zero[d], one[d], pw[d] = f, z, o, (1.0 if d == 0 else 0.0)
        for i in range(d - 1, -1, -1):
            pw[i + 1] += o * pw[i] * (i + 1) / (d + 1)
            pw[i] = z * pw[i] * (d - i) / (d + 1)

    def unwind(d, k):
        o, z = one[k].copy(), zero[k]
        nxt = pw[d].copy()
        has = o != 0
        safe_o = np.where(has, o, 1.0)
        for i in range(d - 1, -1, -1):
            tmp = pw[i].copy()
            a = nxt * (d + 1) / ((i + 1) * safe_o)
            b = tmp * (d + 1) / (z * (d - i)) if z != 0 else tmp * 0.0
            pw[i] = np.where(has, a, b)
            nxt = np.where(has, tmp - pw[i] * z * (d - i) / (d + 1), nxt)
        for i in range(k, d):
            feat[i], zero[i], one[i] = feat[i + 1], zero[i + 1], one[i + 1]

    def unwound_sum(d, k):
        o, z = one[k], zero[k]
        has = o != 0
        safe_o = np.where(has, o, 1.0)
        nxt = pw[d].copy()
        tot_a = np.zeros(nrow)
        tot_b = np.zeros(nrow)
        for i in range(d - 1, -1, -1):
            tmp = nxt / ((i + 1) * safe_o)
            tot_a += tmp
            nxt = pw[i] - tmp * z * (d - i)
            if z != 0:
                tot_b += pw[i] / (z * (d - i))
        return np.where(has, tot_a, tot_b) * (d + 1)

    def recurse(node, d, z, o, f):
        # the path of the caller occupies slots [0, d); save it, work in place, restore
        saved = (feat[:d + 1].copy(), zero[:d + 1].copy(), one[:d + 1].copy(), pw[:d + 1].copy())
        extend(d, z, o, f)
        if t["left"][node] < 0:
            v = t["value"][node] * scale
            for i in range(1, d + 1):
                w = unwound_sum(d, i)
                phi[:, feat[i]] += w * (one[i] - zero[i]) * v
        else:
            sf = t["feature"][node]
            go_left = x[:, sf] <= t["threshold"][node]
            cover = t["cover"][node]
            lc, rc = t["left"][node], t["right"][node]
            in_z, in_o = 1.0, np.ones(nrow)
            dd = d
            hit = [k for k in range(0, d + 1) if feat[k] == sf]
            if hit:
                k = hit[0]
                in_z, in_o = zero[k], one[k].copy()
                unwind(d, k)
                dd = d - 1
            recurse(lc, dd + 1, t["cover"][lc] / cover * in_z, in_o * go_left, sf)
            recurse(rc, dd + 1, t["cover"][rc] / cover * in_z, in_o * (~go_left), sf)
        feat[:d + 1], zero[:d + 1], one[:d + 1], pw[:d + 1] = saved

    recurse(0, 0, 1.0, np.ones(nrow), -1)


def _leaf_paths(t: dict) -> list[tuple]:
    """Per leaf: (leaf, {feature of its path: [share of the cover that follows, [(node, goes left)]]})."""
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        if t["left"][node] < 0:
            out.append((node, path))
            continue
        f = int(t["feature"][node])
        for child, is_left in ((t["right"][node], False), (t["left"][node], True)):
            share, steps = path.get(f, (1.0, []))
            todo.append((child, {**path, f: (share * float(t["cover"][child] / t["cover"][node]), [*steps, (node, is_left)])}))
    return out


def _outcomes(zero: np.ndarray) -> np.ndarray:
    """Shapley values [leaf, feature, outcome] of leaves of value 1 with cover shares ``zero`` [leaf, feature].

    Bit j of an outcome says that the row follows every step on feature j.  The weight of a
    coalition of k features is k! (m - k - 1)! / m!, and the products of one and zero
    fractions over all coalitions of a size are the coefficients of one polynomial."""
    leaves, m = zero.shape
    ones = ((np.arange(1 << m)[None, :] >> np.arange(m)[:, None]) & 1).astype(float)         # [feature, outcome]
    weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    out = np.empty((leaves, m, 1 << m))
    for j in range(m):
        poly = np.zeros((m, leaves, 1 << m))
        poly[0] = 1.0
        for i in (i for i in range(m) if i != j):
            z = zero[:, i, None]
            for k in range(m - 1, 0, -1):
                poly[k] = poly[k] * z + poly[k - 1] * ones[i]
            poly[0] = poly[0] * z
        out[:, j] = sum(w * p for w, p in zip(weight, poly)) * (ones[j] - zero[:, j, None])
    return out


def _tables(t: dict) -> list[tuple]:
    """Per leaf below a split: (features, their steps, contributions [feature, outcome]); kept beside the tree's nodes."""
    if "tables" not in t:
        by_size: dict[int, list] = {}
        for leaf, path in _leaf_paths(t):
            if path:
                by_size.setdefault(len(path), []).append((leaf, path))
        t["tables"] = []
        for group in by_size.values():
            values = _outcomes(np.array([[share for share, _ in path.values()] for _, path in group]))
            for (leaf, path), v in zip(group, values):
                t["tables"].append((list(path), [steps for _, steps in path.values()], v * (t["value"][leaf] * t["weight"] * 2.0)))
    return t["tables"]


def _add_contributions(t: dict, columns: np.ndarray, phi: np.ndarray) -> None:
    """Add one tree's contributions for a batch ``columns`` (features x rows) to ``phi`` (features x rows)."""
    if t["depth"] > TABLE_DEPTH:
        deep = np.zeros(phi.T.shape)
        _tree_shap(t, columns.T, deep)
        phi += deep.T
        return
    go = {}
    for node in np.flatnonzero(t["left"] >= 0):
        left = columns[t["feature"][node]] <= t["threshold"][node]
        go[node, True], go[node, False] = left, ~left
    for features, steps, values in _tables(t):
        outcome = np.zeros(columns.shape[1], np.uint8)
        for j, path in enumerate(steps):
            follows = go[path[0]]
            for step in path[1:]:
                follows = follows & go[step]
            outcome |= follows.view(np.uint8) << np.uint8(j)
        at = outcome.astype(np.intp)
        for f, v in zip(features, values):
            phi[f] += v[at]


def contributions_fn(trees: list[dict], feature_cols, id_col: str = CUST):
    """A ``mapInPandas`` function: id, contributions (array, log-odds), margin."""
    base = 2.0 * expected_margin(trees)

    def run(batches):
        for pdf in batches:
            x = pdf[list(feature_cols)].to_numpy(dtype=float)
            columns = np.ascontiguousarray(x.T)
            phi = np.zeros_like(columns)
            for t in trees:
                _add_contributions(t, columns, phi)
            phi = np.ascontiguousarray(phi.T)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(),
                                "contributions": list(phi),
                                "base_value": base,
                                "margin": phi.sum(axis=1) + base})
    return run


def contributions(df: DataFrame, trees: list[dict], feature_cols=config.FEATURE_COLS) -> DataFrame:
    """Per-row contributions for every row of ``df`` (features already
    cleaned of Inf / NaN)."""
    sc = df.sparkSession.sparkContext
    bc = sc.broadcast(trees)                       # bounded by n_trees x nodes per tree
    cols = list(feature_cols)
    # CPU-bound Python stage: always dealt by id over the session's shuffle partitions
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), CUST)

    def run(batches):
        yield from contributions_fn(bc.value, cols)(batches)
    schema = f"{CUST} string, contributions array<double>, base_value double, margin double"
    return df.select(CUST, *[F.col(c).cast("double") for c in cols]).mapInPandas(run, schema)


def feature_importance(contrib: DataFrame, feature_cols=config.FEATURE_COLS) -> DataFrame:
    """Mean |contribution| per feature over all rows, largest first."""
    means = contrib.agg(*[F.avg(F.abs(F.element_at("contributions", i + 1))).alias(f"_m{i}")
                          for i in range(len(feature_cols))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_m{i}").alias("importance"))
                     for i, c in enumerate(feature_cols)])
    return (means.select(F.explode(rows).alias("r")).select("r.*")
            .orderBy(F.col("importance").desc(), "feature"))


def top_reasons(scored: DataFrame, contrib: DataFrame, n: int | None = config.EXPLAIN_TOP_N,
                feature_cols=config.FEATURE_COLS, per_customer: int = 3) -> DataFrame:
    """M16 + W5 + C7 + C8: the n highest-risk customers (None: all) with their three
    strongest features (by |contribution|) as readable reasons."""
    risk = "churn_score" if "churn_score" in scored.columns else "churn_probability"   # raw score ranks
    top = scored if n is None else scored.orderBy(F.col(risk).desc(), F.col(CUST)).limit(n)
    names = F.array(*[F.lit(c) for c in feature_cols])
    vals = F.array(*[F.col(c).cast("double") for c in feature_cols])
    j = top.select(CUST, "churn_probability", vals.alias("_vals")).join(contrib, CUST, "inner")
    items = F.transform(F.sequence(F.lit(1), F.size("contributions")),
                        lambda i: F.struct(F.abs(F.element_at("contributions", i)).alias("mag"),
                                           (F.lit(0) - i).alias("neg_i"),
                                           F.element_at(names, i).alias("feature"),
                                           F.element_at("_vals", i).alias("feature_value"),
                                           F.element_at("contributions", i).alias("shap_value")))
    ranked = F.slice(F.reverse(F.array_sort(items)), 1, per_customer)
    ex = j.select(CUST, "churn_probability", F.posexplode(ranked).alias("reason_rank", "r"))
    lab = feature_label(F.col("r.feature"))
    return ex.select(CUST, round_half_even("churn_probability", 4).alias("churn_probability"),
                     (F.col("reason_rank") + 1).alias("reason_rank"),
                     F.col("r.feature").alias("feature"), lab.alias("human_description"),
                     round_half_even("r.feature_value", 2).alias("feature_value"),
                     round_half_even("r.shap_value", 4).alias("shap_value"),
                     F.when(F.col("r.shap_value") > 0, "increases").otherwise("decreases").alias("direction"),
                     explanation_text(lab, F.col("r.feature_value"), F.col("r.shap_value")).alias("explanation"))


