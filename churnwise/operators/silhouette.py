"""Euclidean silhouette of several clusterings in one pass over pairs (M2).

A point's silhouette needs its mean distance to every cluster, so the exact
score compares each point with all others.  Equal points are folded first
(``n`` rows each).  The distinct points are dealt into stripes, at most
``MAX_STRIPES`` of them while a stripe stays below ``MOST_ROWS``, so that each
point meets few tasks.  A task holds two stripes and computes each distance
between them once, for both of its ends, in blocks that stay in the cache: rows
are sorted by their clusters, so a block adds up by runs of rows.  Sums of a
point add up over the tasks natively, and silhouettes and their mean are
expressions.  Work is the square of the number
of distinct points; ``every`` scores only the points whose hash it divides, each
still against all rows.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIPE_ROWS, MOST_ROWS, MAX_STRIPES = 8_192, 131_072, 32
BLOCK, TILE = 16, 8_192

# ship this module's code with the task closure, so executors need no install
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: rely on an installed package
    pass


def _floats(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(float) for c in names], axis=1)


class _Stripe:
    """A stripe's points in the order of their clusters, as arrays."""

    def __init__(self, table: pa.Table, axes: list[str], labels: list[str], ks: list[int]):
        first = np.concatenate([[0], np.cumsum(ks)[:-1]])
        at = np.stack([table.column(c).to_numpy().astype(np.int64) + f for c, f in zip(labels, first)], axis=1)
        order = np.lexsort(at.T[::-1])
        self.at = at[order]                                          # columns of the point's clusters
        self.x = np.ascontiguousarray(_floats(table, axes)[order].T)
        self.n = table.column("n").to_numpy().astype(float)[order]
        self.scored = table.column("scored").to_numpy(zero_copy_only=False)[order]

    def __len__(self) -> int:
        return len(self.n)

    def only(self, keep: np.ndarray) -> "_Stripe":
        out = object.__new__(_Stripe)
        out.at, out.x, out.n, out.scored = self.at[keep], self.x[:, keep], self.n[keep], self.scored[keep]
        return out

    def runs(self, lo: int, hi: int) -> np.ndarray:
        """Starts of the runs of equal clusters among the rows from ``lo`` to ``hi``, counted from ``lo``."""
        return np.concatenate([[0], np.flatnonzero((self.at[lo + 1: hi] != self.at[lo: hi - 1]).any(axis=1)) + 1])


def _pairs(q: _Stripe, data: _Stripe, total: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the distances of ``q`` to the data rows of every cluster and, with ``both``, of the data rows to those of ``q``."""
    ahead, back = np.zeros((len(q), total)), np.zeros((total, len(data)))
    if not len(q) or not len(data):
        return ahead, back
    edges = np.concatenate([q.runs(0, len(q)), [len(q)]]).tolist()
    room, spare = np.empty((2, BLOCK * TILE))
    for t in range(0, len(data), TILE):
        end = min(t + TILE, len(data))
        x, n, runs = data.x[:, t: end], data.n[t: end], data.runs(t, end)
        into = np.zeros((len(runs), total))
        into[np.arange(len(runs))[:, None], data.at[t + runs]] = 1.0
        folded = bool((n != 1.0).any())
        for start, stop in zip(edges, edges[1:]):
            met = np.zeros(end - t)
            for lo in range(start, stop, BLOCK):
                hi = min(lo + BLOCK, stop)
                shape = (hi - lo, end - t)
                d, w = room[: shape[0] * shape[1]].reshape(shape), spare[: shape[0] * shape[1]].reshape(shape)
                for j in range(len(x)):
                    to = w if j else d
                    np.subtract(q.x[j, lo: hi, None], x[j], out=to)
                    np.multiply(to, to, out=to)
                    if j:
                        np.add(d, w, out=d)
                np.sqrt(d, out=d)
                ahead[lo: hi] += np.add.reduceat(np.multiply(d, n, out=w) if folded else d, runs, axis=1) @ into
                if both:
                    met += q.n[lo: hi] @ d
            if both:
                back[q.at[start], t: end] += met
    return ahead, back


def _distance_sums(cell: pa.Table, axes: list[str], labels: list[str], ks: list[int]) -> pa.Table:
    """The scored points of a pair of stripes, and the sum of their distances to the other stripe's rows of every cluster of every clustering."""
    side = cell.column("stripe").to_numpy()
    low, high, total = side.min(), side.max(), sum(ks)
    a = _Stripe(cell.filter(pa.array(side == low)), axes, labels, ks)
    if low == high:
        a_scored = a.only(a.scored)
        found = [(a_scored, _pairs(a_scored, a, total, False)[0])]
    else:
        b = _Stripe(cell.filter(pa.array(side == high)), axes, labels, ks)
        if a.scored.all() and b.scored.all():
            ahead, back = _pairs(a, b, total, True)
            found = [(a, ahead), (b, back.T)]
        else:
            a_scored, b_scored = a.only(a.scored), b.only(b.scored)
            found = [(a_scored, _pairs(a_scored, b, total, False)[0]), (b_scored, _pairs(b_scored, a, total, False)[0])]
    x, sums = np.concatenate([s.x for s, _ in found], axis=1), np.concatenate([v for _, v in found])
    return pa.table([*[pa.array(r) for r in x], *[pa.array(np.ascontiguousarray(c)) for c in sums.T]],
                    names=[*axes, *[f"s{j}" for j in range(total)]])


def silhouettes(points: DataFrame, labels: dict[int, str], features: str = "rfm_scaled", every: int = 1) -> dict[int, float]:
    """Mean Euclidean silhouette per clustering; ``labels`` names the cluster column (0 to k - 1) of each k.

    A point alone in its cluster counts 0, and so does every point of a
    clustering with one cluster in use; equal points are rows of their own in
    all means.  No rows give 0.
    """
    spark = points.sparkSession
    first = points.select(features).head(1)
    if not first:
        return {k: 0.0 for k in labels}
    ks, names = list(labels), list(labels.values())
    axes = [f"x{j}" for j in range(len(first[0][0]))]
    x = vector_to_array(F.col(features))
    distinct = (points.select(*[(F.get(x, F.lit(j)) + 0.0).alias(a) for j, a in enumerate(axes)], *names)
                .groupBy(*axes).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in names]).persist())
    # rows per cluster: a few numbers per k
    sizes = distinct.agg(F.count(F.lit(1)).alias("_all"),
                         *[F.coalesce(F.sum(F.when(F.col(c) == j, F.col("n"))), F.lit(0)).alias(f"{c}:{j}") for k, c in labels.items() for j in range(k)]).first()
    points_n = sizes["_all"]
    stripes = max(1, -(-points_n // MOST_ROWS), min(MAX_STRIPES, -(-points_n // STRIPE_ROWS)))
    hashed, total = F.xxhash64(*axes), sum(ks)
    # each stripe meets every other once, and itself
    met = (distinct.withColumn("stripe", F.pmod(hashed, F.lit(stripes)).cast("int"))
           .select(*axes, "n", *names, "stripe", (F.pmod(F.shiftright(hashed, 20), F.lit(every)) == 0).alias("scored"),
                   F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("other"))
           .withColumns({"q": F.least("stripe", "other"), "d": F.greatest("stripe", "other")}).drop("other"))
    schema = ", ".join(f"{c} double" for c in [*axes, *[f"s{j}" for j in range(total)]])
    sums = (met.repartition(stripes * (stripes + 1) // 2, "q", "d").groupBy("q", "d")
            .applyInArrow(lambda cell: _distance_sums(cell, axes, names, ks), schema)
            .groupBy(*axes).agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(total)]))
    scored, at = sums.join(distinct, axes), 0
    means = []
    for k, c in labels.items():
        cluster = [sizes[f"{c}:{j}"] for j in range(k)]
        mean = [F.col(f"s{at + j}") / F.lit(float(max(cluster[j], 1))) for j in range(k)]
        own = reduce(lambda e, j: e.when(F.col(c) == j, F.col(f"s{at + j}") / F.lit(float(max(cluster[j] - 1, 1)))), range(1, k),
                     F.when(F.col(c) == 0, F.col(f"s{at}") / F.lit(float(max(cluster[0] - 1, 1)))))
        # an array's least ignores nulls: the own cluster and empty ones are left out
        other = F.array_min(F.array(*[F.when(F.col(c) != j, mean[j]) if cluster[j] else F.lit(None).cast("double") for j in range(k)]))
        alone = F.col(c).isin([j for j in range(k) if cluster[j] <= 1]) if any(v <= 1 for v in cluster) else F.lit(False)
        value = F.when(alone | other.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(other - own, F.greatest(other, own)), F.lit(0.0)))
        means.append((F.sum(value * F.col("n")) / F.sum("n")).alias(f"k{k}"))
        at += k
    row = scored.agg(*means).first()
    distinct.unpersist()
    return {k: float(row[f"k{k}"] or 0.0) for k in labels}
