"""Second-order boosted trees on a binned matrix.

Each boosting round grows one tree level by level.  A level is one distributed
aggregate: every partition sums gradients and second derivatives of its rows
per (open node, feature, bin), the sums of a node are added up in a fixed
order in the task that picks its best split, and only the splits reach the
driver, so a tree takes at most ``max_depth`` jobs.  Leaves are Newton steps with an L2 penalty, children need
a least sum of second derivatives, rows are sampled per tree by a hash of
their id and features are drawn per tree.  Nothing depends on how rows are
dealt over partitions except the rounding of the sums.

Rows are binned once into numpy blocks that stay persisted with their running
margin; a tree updates the margins as part of the next tree's first job, and
every ``CHECKPOINT_TREES`` trees the blocks are checkpointed, so a lost
executor replays a few trees at most.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.functions.scalar import finite_or_zero
from churnwise.session import ensure_checkpoint_dir

CUST = "customer_unique_id"
MAX_BINS, LAMBDA, MIN_CHILD, MIN_GAIN = 256, 1.0, 1.0, 1e-6
CHECKPOINT_TREES, MERGE, BLOCK_ROWS = 25, 16, 200_000
#: Rows that go down a tree together, so that what they need stays in the cache.
DESCEND_ROWS = 8192

# ship this module's code with the task closure, so executors need no install
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: rely on an installed package
    pass


def gradients(objective: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted loss by the margin."""
    if objective == "squared":
        return w * (margin - y), w.copy()
    p = 1.0 / (1.0 + np.exp(-margin))
    return w * (p - y), np.maximum(w * p * (1.0 - p), 1e-16)


def sampled(key: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Rows that take part in a tree, by a hash of their id hash."""
    if share >= 1.0:
        return np.ones(len(key), bool)
    x = key ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return (x >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


def descend(tree: dict, columns: np.ndarray, cut: str = "bin") -> np.ndarray:
    """Node that each row of a feature-major matrix reaches."""
    n = columns.shape[1]
    out, flat = np.zeros(n, np.int64), columns.reshape(-1)
    inner, nodes = tree["feature"] >= 0, np.arange(len(tree["feature"]))
    first = np.where(inner, tree["feature"], 0) * n                          # where a node's feature begins
    limit = tree[cut].astype(columns.dtype) if columns.dtype == np.uint8 else tree[cut]
    child = np.stack([np.where(inner, tree["left"], nodes), np.where(inner, tree["right"], nodes)], axis=1).reshape(-1)     # a leaf stays
    rows = np.arange(n)
    for lo in range(0, n, DESCEND_ROWS):
        mine, at = rows[lo: lo + DESCEND_ROWS], out[lo: lo + DESCEND_ROWS]
        for _ in range(tree["depth"]):
            right = flat.take(first.take(at) + mine) > limit.take(at)
            at = child.take(2 * at + right)
        out[lo: lo + DESCEND_ROWS] = at
    return out


def best_splits(hist: np.ndarray, features: np.ndarray, n_cuts: np.ndarray) -> list[tuple | None]:
    """Per node of ``hist`` [node, feature, bin, (g, h)]: (feature, bin, g left, h left, g right, h right) or None.

    The best gain wins; ties go to the first feature, then the lowest bin.
    """
    left = np.cumsum(hist, axis=2)
    total = left[:, :1, -1:, :]
    gl, hl = left[..., 0], left[..., 1]
    gr, hr = total[..., 0] - gl, total[..., 1] - hl
    score = lambda g, h: g * g / (h + LAMBDA)                                      # noqa: E731
    gain = score(gl, hl) + score(gr, hr) - score(total[..., 0], total[..., 1])
    bins = np.arange(hist.shape[2])
    gain = np.where((hl >= MIN_CHILD) & (hr >= MIN_CHILD) & (bins[None, None, :] < n_cuts[features][None, :, None]), gain, -np.inf)
    out: list[tuple | None] = []
    for n in range(len(hist)):
        k = int(np.argmax(gain[n]))
        f, b = divmod(k, hist.shape[2])
        out.append((int(features[f]), b, gl[n, f, b], hl[n, f, b], gr[n, f, b], hr[n, f, b]) if gain[n, f, b] > MIN_GAIN else None)
    return out


class _Tree:
    """A tree while it grows; nodes are numbered in the order they appear."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.g, self.h = [], [], [], [], [], []
        self.depth = 0

    def add(self, g: float, h: float) -> int:
        for column, value in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.g, g), (self.h, h)):
            column.append(value)
        return len(self.feature) - 1

    def arrays(self) -> dict:
        return {"depth": self.depth, **{c: np.array(getattr(self, c)) for c in ("feature", "bin", "left", "right")}}


def _histograms(blocks, tree: dict, open_nodes: list[int], features: np.ndarray, bins: int, objective: str, seed: int, number: int, share: float):
    """Sums of (g, h) of a partition's blocks per open node, feature and bin."""
    slot = np.full(len(tree["feature"]), -1)
    slot[open_nodes] = np.arange(len(open_nodes))
    total = np.zeros((len(open_nodes), len(features), bins, 2))
    for x, y, w, key, margin in blocks:
        mine = slot[descend(tree, x)]
        rows = np.flatnonzero((mine >= 0) & sampled(key, seed, number, share))
        g, h = gradients(objective, margin[rows], y[rows], w[rows])
        base = mine[rows] * bins
        for j, f in enumerate(features):
            cell = base + x[f, rows]
            for k, v in enumerate((g, h)):
                total[:, j, :, k] += np.bincount(cell, v, len(open_nodes) * bins).reshape(len(open_nodes), bins)
    return total


def _added(rdd, parts: int) -> np.ndarray:
    """Sum of one array per partition, keyed by its number, always in the same order; no task adds more than ``MERGE``."""
    while parts > MERGE:
        parts = -(-parts // MERGE)
        rdd = (rdd.map(lambda kv: (kv[0] // MERGE, kv)).groupByKey(parts)
               .map(lambda kv: (kv[0], sum(a for _, a in sorted(kv[1], key=lambda p: p[0])))))
    return sum(a for _, a in sorted(rdd.collect(), key=lambda p: p[0]))


def _merged(pairs):
    """Sum of one array per (partition, node) of a task, by its partitions' group: ((group, node), array)."""
    found: dict[tuple, list] = {}
    for (i, node), a in pairs:
        found.setdefault((i // MERGE, node), []).append((i, a))
    return [(key, sum(a for _, a in sorted(pieces, key=lambda p: p[0]))) for key, pieces in found.items()]


def _per_node(rdd, parts: int, nodes: int, choose) -> dict:
    """``choose(sum)`` per node of one array per (partition, node), added always in the same order where it is chosen:
    what reaches the driver is a result per node, whatever the arrays' size."""
    while parts > 1:
        groups = -(-parts // MERGE)
        rdd = rdd.map(lambda kv: (kv[0][0] // MERGE * nodes + kv[0][1], kv)).partitionBy(groups * min(-(-nodes // 4), 4), int) \
            .values().mapPartitions(_merged)
        parts = groups
    return dict(rdd.map(lambda kv: (kv[0][1], choose(kv[1]))).collect())


def _binned(batches, cuts: list[np.ndarray]):
    """(key, y, w, features) to one row per block of rows, as bytes."""
    held: list[pa.RecordBatch] = []

    def out():
        t = pa.Table.from_batches(held)
        cols = [t.column(i).to_numpy() for i in range(t.num_columns)]
        x = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, cols[3:])]).astype(np.uint8)
        key, y, w = cols[0].astype(np.int64).view(np.uint64), cols[1].astype(np.float64), cols[2].astype(np.float64)
        return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64())] + [pa.array([a.tobytes()], pa.binary()) for a in (x, y, w, key)], ["n", "x", "y", "w", "key"])
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield out()
            held = []
    if held and sum(b.num_rows for b in held):
        yield out()


@dataclass
class BoostedTrees:
    """A fitted ensemble: trees over named features, a base margin, and what is known of its training."""
    objective: str
    features: list[str]
    base: float
    trees: list[dict] = field(default_factory=list)
    info: dict = field(default_factory=dict)

    @property
    def numFeatures(self) -> int:
        return len(self.features)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margin of each row of ``x`` (rows x features)."""
        columns, out = np.ascontiguousarray(x.T), np.full(len(x), self.base)
        for t in self.trees:
            out += t["value"][descend(t, columns, "threshold")]
        return out

    def margin(self) -> Column:
        """The margin of a row from its raw feature columns (Inf, NaN and null count as 0)."""
        model = self

        @F.pandas_udf("double")
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.margins(np.column_stack([c.to_numpy(np.float64) for c in columns])))
        return run(*[finite_or_zero(c).cast("double") for c in self.features])

    def explained(self) -> list[dict]:
        """The trees as :mod:`churnwise.operators.explain` reads them (which doubles weights); the base is a tree of one leaf."""
        leaf = {"depth": 0, "left": np.array([-1]), "right": np.array([-1]), "feature": np.array([-1]), "threshold": np.array([np.nan]),
                "value": np.array([self.base]), "cover": np.array([1.0]), "weight": 0.5}
        return [{**{k: t[k] for k in ("depth", "left", "right", "feature", "threshold", "value", "cover")}, "weight": 0.5} for t in self.trees] + [leaf]

    def save(self, spark: SparkSession, path: str, info: dict | None = None) -> None:
        """The nodes as a table, then the metadata (objective, feature order, base, training facts), which marks the model complete."""
        rows = [(i, j, *(int(t[c][j]) for c in ("feature", "left", "right")), float(t["threshold"][j]), float(t["value"][j]), float(t["cover"][j]))
                for i, t in enumerate(self.trees) for j in range(len(t["feature"]))]
        spark.createDataFrame(rows, "tree int, node int, feature int, left int, right int, threshold double, value double, cover double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"objective": self.objective, "features": self.features, "base": self.base, "trees": len(self.trees), "info": {**self.info, **(info or {})}}
        spark.createDataFrame([(json.dumps(meta),)], "metadata string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/metadata").first()["metadata"])


def load(spark: SparkSession, path: str) -> BoostedTrees:
    """A saved ensemble; its size is bounded by trees and depth."""
    meta = load_metadata(spark, path)
    model = BoostedTrees(meta["objective"], meta["features"], meta["base"], [], meta["info"])
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
    by_tree = dict(list(nodes.groupby("tree")))
    for i in range(meta["trees"]):
        t = {c: by_tree[i][c].to_numpy() for c in ("feature", "left", "right", "threshold", "value", "cover")}
        t["depth"] = _depth(t["left"], t["right"])
        model.trees.append(t)
    return model


def _depth(left: np.ndarray, right: np.ndarray) -> int:
    level, depth = [0], -1
    while level:
        level, depth = [c for n in level for c in (left[n], right[n]) if c >= 0], depth + 1
    return depth


def feature_cuts(rows: DataFrame, features: list[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Split candidates per feature: its distinct quantiles below the largest value (one sketch job for all features)."""
    probs = [i / bins for i in range(1, bins)] + [1.0]
    out = []
    for q in rows.approxQuantile(features, probs, 0.1 / bins):
        values = np.unique(np.array(q, dtype=np.float64))
        out.append(values[values < values[-1]] if len(values) else values)
    return out


def fit(train: DataFrame, features: list[str], label: str, objective: str = "logistic", weight: str | None = None, n_trees: int = 200,
        max_depth: int = 6, learning_rate: float = 0.1, row_sample: float = 0.8, feature_sample: float = 0.8, seed: int = 42,
        id_col: str = CUST) -> BoostedTrees:
    """Fit an ensemble; ``objective`` is ``logistic`` (label 0 / 1) or ``squared``.  Empty input gives the base alone."""
    spark = train.sparkSession
    features = list(features)
    names = [f"f{i}" for i in range(len(features))]
    rows = train.select(F.xxhash64(F.col(id_col)).alias("key"), F.col(label).cast("double").alias("y"),
                        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                        *[finite_or_zero(c).cast("double").alias(n) for c, n in zip(features, names)])
    ensure_checkpoint_dir(spark)
    cuts = feature_cuts(rows, names)
    n, mean = rows.agg(F.count(F.lit(1)), F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()
    model = BoostedTrees(objective, features, float(mean or 0.0) if objective == "squared" else 0.0, [], {"rows": int(n)})
    if not n:
        return model
    base, d, bins, n_cuts = model.base, len(features), max(len(c) for c in cuts) + 1, np.array([len(c) for c in cuts])

    def unpacked(r):
        y, w, key = np.frombuffer(r.y), np.frombuffer(r.w), np.frombuffer(r.key, np.uint64)
        return np.frombuffer(r.x, np.uint8).reshape(d, r.n), y, w, key, np.full(r.n, base)
    blocks = rows.mapInArrow(lambda b: _binned(b, cuts), "n long, x binary, y binary, w binary, key binary").rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    parts, old = blocks.getNumPartitions(), None
    rng = np.random.default_rng(seed)
    for number in range(n_trees):
        used = np.sort(rng.choice(d, max(1, int(feature_sample * d)), replace=False))
        tree, open_nodes = _Tree(), [0]
        tree.add(0.0, 0.0)
        for level in range(max_depth):
            now = tree.arrays()
            found = _per_node(blocks.mapPartitionsWithIndex(
                lambda i, it, now=now, nodes=list(open_nodes), used=used, number=number:
                [((i, s), a) for s, a in enumerate(_histograms(it, now, nodes, used, bins, objective, seed, number, row_sample))]),
                parts, len(open_nodes), lambda a, used=used: (a[0].sum(axis=0), best_splits(a[None], used, n_cuts)[0]))
            if old is not None:
                old.unpersist()
                old = None
            if level == 0:
                tree.g[0], tree.h[0] = found[0][0]
            grown = []
            for s, node in enumerate(open_nodes):
                split = found[s][1]
                if split is not None:
                    tree.feature[node], tree.bin[node] = split[0], split[1]
                    tree.left[node], tree.right[node] = tree.add(split[2], split[3]), tree.add(split[4], split[5])
                    grown += [tree.left[node], tree.right[node]]
            if not grown:
                break
            tree.depth, open_nodes = level + 1, grown
        done = tree.arrays()
        g, h = np.array(tree.g), np.array(tree.h)
        value = np.where(done["feature"] < 0, -learning_rate * g / (h + LAMBDA), 0.0)
        threshold = np.array([cuts[f][b] if f >= 0 else np.nan for f, b in zip(done["feature"], done["bin"])])
        model.trees.append({**{k: done[k] for k in ("depth", "feature", "left", "right")}, "threshold": threshold, "value": value, "cover": h})
        if number + 1 < n_trees:
            old = blocks
            blocks = blocks.map(lambda b, done=done, value=value: (*b[:4], b[4] + value[descend(done, b[0])])).persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % CHECKPOINT_TREES == 0:
                blocks.checkpoint()
    for r in (blocks, old):
        if r is not None:
            r.unpersist()
    return model
