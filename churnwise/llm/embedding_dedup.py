"""Embedding near-dedup: a cover tree and its dual traversal give all pairs of cosine >= 0.95.

1. Equal vectors are one node (folded on the map side); unit vectors of cosine
   c lie sqrt(2 - 2 c) apart, so the threshold is a distance.
2. The tree's centres are fitted on a bounded sample in greedy order: each
   centre is the sample's farthest point from those before it, and its level
   is the halving of the radius at which it entered.  Levels are nested and
   every node covers its children.  Results do not depend on the sample.
3. Every vector descends to its nearest finest centre; a leaf's vectors are cut
   into shells by distance, blocks of about ``BLOCK`` rows.  Covering radii are
   the measured largest distances over all vectors.
4. The dual traversal starts at (root, root).  A pair of nodes is dropped when
   centre distance less both radii exceeds the threshold, taken whole when
   centre distance plus both radii is within it, and split otherwise.
5. Taken pairs add block sizes to the link counts and one link to the
   components.  The rest are compared block against block.  A task holds two
   tiles of neighbouring blocks and compares all their listed pairs, in single
   precision first; it returns link counts and a spanning forest, never the
   pairs of a group.  Tasks run in rounds that move about ``ROUND`` times the
   vectors, and a round's shuffle files go before the next, so the disk in use
   does not grow with the number of pairs.
6. Rows find their vector by its hashes, or by the vector itself should two
   vectors of the table share them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.llm.common import stage
from churnwise.llm.components import components
from churnwise.session import cut_parts, drop_stage

COSINE = 0.95
#: Rows of a block on average; more when there would be over ``MOST_BLOCKS``.
BLOCK, MOST_BLOCKS = 2048, 4096
#: Bytes of a tile's vectors, and the least number of tiles while a tile has several blocks.
TILE_BYTES, TILES = 16 << 20, 16
#: Vectors that a round moves, as a share of all, and the least bytes of a round.
ROUND, ROUND_BYTES = 1.5, 128 << 20
#: Bound of the sample and of the number of finest centres.
SAMPLE, CENTRES = 4096, 1024
#: Room for rounding when bounds are compared with the threshold.
SLACK = 1e-9


class CoverTree:
    """Nested centres with halving radii.  Node = (level, centre); ``parent`` and ``level`` follow the greedy order."""

    def __init__(self, sample: np.ndarray, centres: int):
        self.points = np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
        self.level, self.parent = [], []
        if not len(sample):
            return
        near, picked, entered = np.full(len(sample), np.inf), [], []
        at = 0
        while len(picked) < centres:
            picked.append(at)
            entered.append(float(near[at]) if len(picked) > 1 else 2.0)
            near = np.minimum(near, np.linalg.norm(sample - sample[at], axis=1))
            at = int(np.argmax(near))
            if near[at] <= SLACK:
                break
        self.points = sample[picked]
        self.level = [0] + [max(1, int(np.ceil(-np.log2(max(e, SLACK) / 2.0) + SLACK))) for e in entered[1:]]
        for i in range(len(picked)):
            if i == 0:
                self.parent.append(-1)
                continue
            before = [j for j in range(i) if self.level[j] < self.level[i]]
            d = np.linalg.norm(self.points[before] - self.points[i], axis=1)
            self.parent.append(before[int(np.argmin(d))])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Finest centre of each vector and the distance to it."""
        dot = x @ self.points.T
        leaf = np.argmax(dot, axis=1)
        return leaf, np.linalg.norm(x - self.points[leaf], axis=1)

    def traverse(self, blocks: pd.DataFrame, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Dual traversal.  blocks: block, leaf, low, high (distances from the leaf's centre).

        Returns block pairs to compare and block pairs that link as a whole.
        """
        kids: list[list[int]] = [[] for _ in self.parent]
        for i, p in enumerate(self.parent):
            if p >= 0:
                kids[p].append(i)
        own = {int(leaf): (t["block"].to_numpy(), t["low"].to_numpy(), t["high"].to_numpy()) for leaf, t in blocks.groupby("leaf")}
        # radius of a centre's own blocks, and of its whole subtree
        alone = [float(own[i][2].max()) if i in own else -1.0 for i in range(len(kids))]
        radius = list(alone)
        under: list[list[int]] = [[i] for i in range(len(kids))]
        for i in sorted(range(len(kids)), key=lambda i: -self.level[i]):
            for k in kids[i]:
                under[i] += under[k]
            has = [j for j in under[i] if alone[j] >= 0]
            radius[i] = max((float(np.linalg.norm(self.points[i] - self.points[j])) + alone[j] for j in has), default=-1.0)
        none = np.zeros((0, 2), np.int32)
        compare, whole = [none], [none]
        # an entry is (centre, is it the centre's own blocks only)
        todo = [((0, False), (0, False))] if kids else []
        while todo:
            (a, a_own), (b, b_own) = todo.pop()
            ra, rb = alone[a] if a_own else radius[a], alone[b] if b_own else radius[b]
            if ra < 0 or rb < 0:
                continue
            d = float(np.linalg.norm(self.points[a] - self.points[b]))
            if d - ra - rb > reach + SLACK:
                continue
            if a_own and b_own:
                self._block_pairs(own[a], own[b], a == b, d, reach, compare, whole)
            elif (a, a_own) == (b, b_own):
                parts = [(a, True)] + [(k, False) for k in kids[a]]
                todo += [(parts[i], parts[j]) for i in range(len(parts)) for j in range(i, len(parts))]
            elif b_own or (not a_own and ra >= rb):
                todo += [(x, (b, b_own)) for x in [(a, True)] + [(k, False) for k in kids[a]]]
            else:
                todo += [((a, a_own), x) for x in [(b, True)] + [(k, False) for k in kids[b]]]
        return np.concatenate(compare), np.concatenate(whole)

    @staticmethod
    def _block_pairs(left, right, same, d, reach, compare, whole) -> None:
        (x, x_low, x_high), (y, y_low, y_high) = [c[:, None] for c in left], right
        # nearest possible: shells of one centre, or balls around two
        gap = np.maximum(np.maximum(d - x_high - y_high, x_low - y_high - d), y_low - x_high - d)
        near = gap <= reach + SLACK
        if same:
            near &= y >= x
        all_of = near & (d + x_high + y_high <= reach - SLACK)
        for into, take in ((whole, all_of), (compare, near & ~all_of)):
            i, j = np.nonzero(take)
            into.append(np.stack([left[0][i], right[0][j]], axis=1).astype(np.int32))


def valid(embedding: str = "embedding") -> F.Column:
    """Vectors with components, none of them null or not finite, and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def unit_rows(vectors) -> np.ndarray:
    """Unit vectors of vectors of one length: a list column, or a sequence of arrays."""
    if isinstance(vectors, (pa.Array, pa.ChunkedArray)):
        flat = pc.list_flatten(vectors)
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    else:
        x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)           # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(shared):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf, d = shared.value.nearest(unit_rows(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(d)], [*batch.schema.names, "leaf", "d"])
    return run


def _near(x: np.ndarray, single: np.ndarray, a: slice, b: slice, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the slices a and b of at least this cosine.  Single precision, with room for its rounding, leaves few pairs to be computed again."""
    i, j = np.divmod(np.flatnonzero(single[a] @ single[b].T >= cosine - (x.shape[1] + 4) * 2.0 ** -23), max(b.stop - b.start, 1))
    if len(i) > b.stop - b.start:
        i, j = np.nonzero(x[a] @ x[b].T >= cosine)
    else:
        at = np.einsum("ij,ij->i", x[a][i], x[b][j]) >= cosine
        i, j = i[at], j[at]
    return i + a.start, j + b.start


def _compare(cosine: float, pairs):
    def run(cell: pa.Table) -> pa.Table:
        """Links between the listed block pairs of a cell: counts per node, and a spanning forest."""
        cell = cell.sort_by("block")
        block, node, n = (cell.column(c).to_numpy() for c in ("block", "node", "n"))
        x = unit_rows(cell.column("v"))
        single = x.astype(np.float32)
        links, ea, eb = np.zeros(len(x), np.int64), [], []
        parent = np.arange(len(x))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i
        listed = pairs.value[cell.column("cell")[0].as_py()]
        edges = np.searchsorted(block, listed), np.searchsorted(block, listed, side="right")
        for (p, q), (lo, other), (end, stop) in zip(listed.tolist(), *map(np.ndarray.tolist, edges)):
            for at in range(lo, end, 512):
                i, j = _near(x, single, slice(at, min(at + 512, end)), slice(other, stop), cosine)
                if p == q:
                    i, j = i[i < j], j[i < j]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                for s, t in zip(i.tolist(), j.tolist()):
                    rs, rt = root(s), root(t)
                    if rs != rt:
                        parent[rt] = rs
                        ea.append(node[s])
                        eb.append(node[t])
        has = np.flatnonzero(links)
        return pa.table({"a": np.concatenate([node[has], np.array(ea, np.int64)]),
                         "b": np.concatenate([np.full(len(has), -1, np.int64), np.array(eb, np.int64)]),
                         "links": np.concatenate([links[has], np.zeros(len(ea), np.int64)])})
    return run


def _blocks(leaves: DataFrame, name: str, per_block: int) -> tuple[DataFrame, pd.DataFrame]:
    """(rows with a block number, block table).  Shells by distance; shells that ties make too large split by hash."""
    spark = leaves.sparkSession
    size = leaves.groupBy("leaf").agg(F.count("*").alias("rows"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / per_block)).cast("int")
    found = leaves.join(F.broadcast(size.filter(F.col("rows") > per_block)), "leaf").groupBy("leaf").agg(   # CENTRES rows at most
        F.percentile_approx("d", [i / 64 for i in range(1, 64)], 2000).alias("q"), F.first(parts).alias("parts")).collect()
    cut = spark.createDataFrame(found, "leaf int, q array<double>, parts int")       # computed once: a sketch may differ the next time
    shelled = leaves.join(F.broadcast(cut), "leaf", "left").withColumn(
        "shell", F.when(F.col("q").isNull(), 0).otherwise(
            F.floor(F.size(F.filter("q", lambda v: v < F.col("d"))) * F.least("parts", F.lit(64)) / 64)).cast("int")).drop("q", "parts")
    count = shelled.groupBy("leaf", "shell").agg(F.count("*").alias("rows"))
    split = F.greatest(F.lit(1), F.ceil(F.col("rows") / (2 * per_block))).cast("int")
    rows = (shelled.join(F.broadcast(count), ["leaf", "shell"])
            .withColumn("piece", F.pmod(F.xxhash64("node"), split).cast("int")))
    table = (rows.groupBy("leaf", "shell", "piece").agg(F.min("d").alias("low"), F.max("d").alias("high"),
                                                        F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("node").alias("first"))
             .toPandas().sort_values(["leaf", "shell", "piece"]).reset_index(drop=True))     # a row per block
    table["block"] = table.index.astype("int64")
    numbers = spark.createDataFrame(table[["leaf", "shell", "piece", "block"]] if len(table) else [], "leaf int, shell int, piece int, block long")
    return stage(rows.join(F.broadcast(numbers), ["leaf", "shell", "piece"]).select("block", "node", "n", "least", "h1", "h2", "v"), f"{name}-blocks"), table


def _hashes(v: str) -> list:
    return [F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2")]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing: n_links 0, a component of their own, kept.  Vectors of
    different length do not link.  Equal vectors link with each other.  Rows
    that repeat a vec_id are rows of their own and count as links; null ids
    are never the smallest.  An empty table gives an empty result.  Columns
    other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"     # exact in both
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    good = d.filter(valid("v")).withColumn("dim", F.size("v"))
    nodes = stage(good.groupBy("v", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
                  .withColumn("node", F.monotonically_increasing_id()), "vec-nodes")
    dims = sorted(r[0] for r in nodes.select("dim").distinct().collect())        # the table's vector lengths
    leaves = [_leaves(nodes.filter(F.col("dim") == dim), dim, kind) for dim in dims]
    drop_stage(nodes)
    counts = spark.createDataFrame([], "node long, links long")
    links = spark.createDataFrame([], "a long, b long")
    named, tables = spark.createDataFrame([], f"node long, n long, least long, h1 long, h2 long, v {kind}"), []
    for dim, found in zip(dims, leaves):
        c, e, rows = _linked(found, cosine, dim)
        for one in c:
            counts = counts.unionAll(one)
        for one in e:
            links = links.unionAll(one)
        named = named.unionAll(rows.select(*named.columns))
        tables.append(rows)
    totals = counts.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(links, "vec")
    # two vectors of the same hashes: rows are then joined by the vectors
    by = ["v"] if not named.groupBy("h1", "h2").count().filter("count > 1").isEmpty() else ["h1", "h2"]
    label = (named.join(found, "node", "left").join(totals, "node", "left")
             .select(*by, "least", "n", F.coalesce("root", "node").alias("root"),
                     (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    label = stage(label, "vec-labels")
    for rows in tables:
        drop_stage(rows)
    ids = label.groupBy("root").agg(F.min("least").alias("component_id"))
    named = label.join(ids, "root").select(*[F.col(c).alias(f"l_{c}") for c in by], "n_links", "component_id", F.lit(True).alias("linked"))
    keys = d.select("vec_id", *[F.when(valid("v"), k).alias(c) for c, k in zip(by, [F.col("v")] if by == ["v"] else _hashes("v"))])
    same = [keys[c] == named[f"l_{c}"] for c in by]
    lone = F.col("linked").isNull()
    return (keys.join(named, same, "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(lone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
                    (lone | F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).alias("kept")))


def _leaves(nodes: DataFrame, dim: int, kind: str) -> tuple:
    """(tree, rows with their finest centre and the distance to it, rows of a block) of the vectors of one length."""
    total = nodes.count()
    per_block = max(BLOCK, -(-total // MOST_BLOCKS))
    sample = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").toPandas()["v"]     # SAMPLE rows at most
    tree = CoverTree(unit_rows(sample), min(CENTRES, max(1, -(-total // per_block))))
    shared = nodes.sparkSession.sparkContext.broadcast(tree)
    leaves = stage(nodes.select("node", "n", "least", *_hashes("v"), "v").mapInArrow(
        _assign(shared), f"node long, n long, least long, h1 long, h2 long, v {kind}, leaf int, d double"), f"vec{dim}-leaves")
    return tree, leaves, per_block


def _cells(compare: np.ndarray, blocks: int, block_bytes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Block pairs by the tiles they lie in: per cell (its pairs, its blocks)."""
    tile = max(1, min(TILE_BYTES // max(block_bytes, 1), blocks // TILES))
    low, high = compare.min(axis=1) // tile, compare.max(axis=1) // tile
    order = np.lexsort((high, low))
    edges = np.flatnonzero(np.concatenate([[True], (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)]))
    parts = np.split(compare[order], edges[1:])
    return [(p, np.unique(p)) for p in parts]


def _linked(found: tuple, cosine: float, dim: int) -> tuple[list, list, DataFrame]:
    """(link counts per node, links that span the components, rows with their blocks) among vectors of one length."""
    tree, leaves, per_block = found
    spark, name = leaves.sparkSession, f"vec{dim}"
    rows, table = _blocks(leaves, name, per_block)
    drop_stage(leaves)
    compare, whole = tree.traverse(table, float(np.sqrt(2 - 2 * cosine)))
    counts, links = [], []
    if len(compare):
        held = table["rows"].to_numpy()
        out = cut_parts(_rounds(rows, held, _cells(compare, len(table), per_block * dim * 8), cosine, dim), f"llm-{name}-links")
        counts.append(out.filter("b < 0").select(F.col("a").alias("node"), "links"))
        links.append(out.filter("b >= 0").select("a", "b"))
    if len(whole):
        size, first = table["n"].to_numpy(), table["first"].to_numpy()
        more = np.zeros(len(table), np.int64)
        x, y = whole.T
        np.add.at(more, x[x != y], size[y[x != y]])
        np.add.at(more, y[x != y], size[x[x != y]])
        add = spark.createDataFrame(pd.DataFrame({"block": table["block"], "add": more, "own": np.isin(table["block"], x[x == y]) * size,
                                                  "head": first}), "block long, add long, own long, head long")
        joined = rows.select("block", "node", "n").join(F.broadcast(add), "block")
        counts.append(joined.select("node", (F.col("add") + F.when(F.col("own") > 0, F.col("own") - F.col("n")).otherwise(0)).alias("links")))
        # a block that links as a whole with itself or another: every member links with a head
        heads = pd.DataFrame({"block": np.concatenate([x, y]).astype(np.int64), "head": first[np.concatenate([y, x])]}).drop_duplicates("block")
        tie = spark.createDataFrame(pd.DataFrame({"a": first[x], "b": first[y]}), "a long, b long")
        links.append(rows.select("block", "node").join(F.broadcast(spark.createDataFrame(heads, "block long, head long")), "block")
                     .select(F.col("node").alias("a"), F.col("head").alias("b")).unionAll(tie).filter("a <> b"))
    return counts, links, rows


def _rounds(rows: DataFrame, held: np.ndarray, cells: list, cosine: float, dim: int):
    """The comparison of the cells, in DataFrames that move a bounded share of the vectors each."""
    spark = rows.sparkSession
    room = max(ROUND * held.sum(), ROUND_BYTES / (dim * 8))
    at = 0
    while at < len(cells):
        start, moved = at, 0
        while at < len(cells) and (at == start or moved + held[cells[at][1]].sum() <= room):
            moved += held[cells[at][1]].sum()
            at += 1
        pairs = spark.sparkContext.broadcast({i: cells[i][0] for i in range(start, at)})
        sides = pd.DataFrame({"cell": np.repeat(np.arange(start, at), [len(b) for _, b in cells[start: at]]),
                              "block": np.concatenate([b for _, b in cells[start: at]]).astype(np.int64)})
        cell = spark.createDataFrame(sides, "cell long, block long")
        yield (rows.join(F.broadcast(cell), "block").select("cell", "block", "node", "n", "v")
               .repartition(2 * (at - start), "cell").groupBy("cell").applyInArrow(_compare(cosine, pairs), "a long, b long, links long"))
        pairs.destroy()


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0
  AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN k USING (vec_id)
"""
