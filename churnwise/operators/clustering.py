"""K-Means with many starts and many k in shared scans (M2, M3).

All centre sets of all starts move together: one distributed aggregate a round
gives every set its sums and counts, so the number of jobs is the number of
rounds of the slowest start, not the sum over starts.  Seeding is k-means||:
a start oversamples distant points in ``SEED_STEPS`` passes, all starts in the
same pass, and reduces its weighted candidates to k by k-means++.  Draws are
hashes of the row's id, so a seed gives the same centres on any layout.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.operators.boosting import BLOCK_ROWS, CUST, _added

SEED_STEPS, CHUNK = 2, 4096

# ship this module's code with the task closure, so executors need no install
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: rely on an installed package
    pass


@dataclass
class Centres:
    """A fitted set of centres with its cost (sum of squared distances)."""
    centres: np.ndarray
    cost: float

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    def transform(self, points: DataFrame, features: str = "rfm_scaled", out: str = "cluster") -> DataFrame:
        """The nearest centre's number beside each row, as an expression; ties go to the lower number."""
        x = vector_to_array(F.col(features))
        d = F.array(*[sum((F.pow(F.get(x, F.lit(i)) - float(v), 2) for i, v in enumerate(c)), F.lit(0.0)) for c in self.centres])
        return points.withColumn(out, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - centres[None, :, j]) ** 2
    return d


def _nearest(x: np.ndarray, sets: list[np.ndarray]):
    """For each chunk of rows and each set: (rows, set number, nearest centre, squared distance); a set's distances of a chunk stay in the cache."""
    most = max(len(c) for c in sets)
    room, spare = np.empty((2, most, CHUNK))
    for lo in range(0, len(x), CHUNK):
        part = np.ascontiguousarray(x[lo: lo + CHUNK].T)
        rows = part.shape[1]
        for s, centres in enumerate(sets):
            d, w = room[: len(centres), :rows], spare[: len(centres), :rows]
            for j, axis in enumerate(part):
                to = w if j else d
                np.subtract(axis, centres[:, j, None], out=to)
                np.multiply(to, to, out=to)
                if j:
                    np.add(d, w, out=d)
            least, at = d[0].copy(), np.zeros(rows, np.int64)
            for j in range(1, len(centres)):
                np.putmask(at, d[j] < least, j)
                np.minimum(least, d[j], out=least)
            yield slice(lo, lo + rows), s, at, least


def _moments(blocks, sets: list[np.ndarray], width: int) -> np.ndarray:
    """Per set and centre: sums of the coordinates, number of rows, sum of squared distances."""
    out = np.zeros((len(sets), max(len(c) for c in sets), width + 2))
    for _, x in blocks:
        for rows, s, at, d in _nearest(x, sets):
            k = len(sets[s])
            for j in range(width):
                out[s, :k, j] += np.bincount(at, x[rows, j], k)
            out[s, :k, width] += np.bincount(at, minlength=k)
            out[s, :k, width + 1] += np.bincount(at, d, k)
    return out


def _packed(batches, width: int):
    held: list[np.ndarray] = []
    keys: list[np.ndarray] = []

    def out():
        x, key = np.concatenate(held), np.concatenate(keys)
        return pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int64()), pa.array([key.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["n", "key", "x"])
    for b in batches:
        keys.append(b.column(0).to_numpy())
        held.append(np.stack([b.column(1 + j).to_numpy() for j in range(width)], axis=1))
        if sum(map(len, keys)) >= BLOCK_ROWS:
            yield out()
            held, keys = [], []
    if sum(map(len, keys)):
        yield out()


def _plus_plus(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ over a start's candidates; fewer distinct candidates than k repeat the first."""
    at = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    d = _squared(candidates, candidates[at])[:, 0]
    while len(at) < k:
        mass = weights * d
        at.append(int(rng.choice(len(candidates), p=mass / mass.sum())) if mass.sum() > 0 else at[0])
        d = np.minimum(d, _squared(candidates, candidates[at[-1:]])[:, 0])
    return candidates[at]


def fit_all(points: DataFrame, ks, n_init: int, seed: int, features: str = "rfm_scaled", max_rounds: int = 300, tolerance: float = 1e-4) -> dict[int, Centres]:
    """The best of ``n_init`` starts for every k; all starts of all k share each scan.

    Fewer points than k give repeated centres; an empty table gives no model.
    """
    x = vector_to_array(F.col(features))
    first = points.select(features).head(1)
    if not first:
        return {}
    width = len(first[0][0])
    rows = points.select(F.xxhash64(CUST).alias("key"), *[F.get(x, F.lit(j)).cast("double").alias(f"x{j}") for j in range(width)])

    def unpacked(r):
        return np.frombuffer(r.key, np.int64).view(np.uint64), np.frombuffer(r.x).reshape(r.n, width)
    blocks = rows.mapInArrow(lambda b: _packed(b, width), "n long, key binary, x binary").rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    parts = blocks.getNumPartitions()

    def moments(sets):
        return _added(blocks.mapPartitionsWithIndex(lambda i, it, sets=sets: [(i, _moments(it, sets, width))]), parts)

    starts = [(k, i) for k in ks for i in range(n_init)]
    seeds = _seeded(blocks, starts, seed, moments)
    active = list(range(len(starts)))
    for _ in range(max_rounds):
        m = moments([seeds[s] for s in active])
        left = []
        for s, sums in zip(active, m):
            k, count = len(seeds[s]), sums[: len(seeds[s]), width]
            moved = np.where(count[:, None] > 0, sums[:k, :width] / np.maximum(count, 1)[:, None], seeds[s])
            if ((moved - seeds[s]) ** 2).sum(axis=1).max() > tolerance ** 2:
                left.append(s)
            seeds[s] = moved
        active = left
        if not active:
            break
    costs = moments(seeds)[:, :, width + 1].sum(axis=1)
    blocks.unpersist()
    best: dict[int, Centres] = {}
    for (k, _), centres, cost in zip(starts, seeds, costs):
        if k not in best or cost < best[k].cost:
            best[k] = Centres(centres, float(cost))
    return best


def _seeded(blocks, starts: list[tuple[int, int]], seed: int, moments) -> list[np.ndarray]:
    """k-means|| for all starts: a first point, ``SEED_STEPS`` passes that draw about 2k points each, k-means++ over the candidates."""
    number = [seed * 1_000_003 + k * 1009 + i for k, i in starts]

    def lowest(it):
        """Each start's point of the lowest hash in the partition."""
        best: list = [None] * len(number)
        for key, x in it:
            for s, n in enumerate(number):
                h = key * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((n * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                j = int(h.argmin())
                if best[s] is None or (int(h[j]), tuple(x[j])) < best[s]:
                    best[s] = (int(h[j]), tuple(x[j]))
        return [best] if best[0] is not None else []
    picked = blocks.mapPartitions(lowest).treeReduce(lambda a, b: [min(p, q) for p, q in zip(a, b)])
    sets = [np.array([p[1]]) for p in picked]
    for step in range(SEED_STEPS):
        cost = moments(sets)[:, :, -1].sum(axis=1)

        def drawn(it, sets=sets, cost=cost, step=step):
            out = []
            for key, x in it:
                for rows, s, _, d in _nearest(x, sets):
                    share = 2 * starts[s][0] * d / cost[s] if cost[s] > 0 else np.zeros(len(d))
                    take = np.flatnonzero(_draw(key[rows], number[s], step) < share)
                    out += [(s, tuple(x[rows][j])) for j in take]
            return out
        for s, found in _by_start(blocks.mapPartitions(drawn).distinct().collect()).items():        # about 2k points a start and step
            sets[s] = np.concatenate([sets[s], np.array(sorted(found))])
    sets = [np.unique(c, axis=0) for c in sets]
    weights = moments(sets)[:, :, -2]
    return [_plus_plus(c, w[: len(c)] + 1e-9, k, np.random.default_rng(n)) for c, w, (k, _), n in zip(sets, weights, starts, number)]


def _draw(key: np.ndarray, number: int, step: int) -> np.ndarray:
    """A number in [0, 1) per row, start and step."""
    h = (key ^ np.uint64((number * 0xD1B54A32D192ED03 + step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(11)) / float(1 << 53)


def _by_start(pairs) -> dict[int, list]:
    out: dict[int, list] = {}
    for s, p in pairs:
        out.setdefault(s, []).append(p)
    return out
