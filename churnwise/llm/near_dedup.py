"""MinHash near-dedup by DartMinHash.

1. A document is the set of its shingles of five words (``weights="count"``
   takes the multiset).  Each unit of a shingle's weight is a region whose
   darts are a Poisson process in rank, fixed by the shingle's hash: their
   ranks, weight positions and coordinates are hashed, so equal shingles throw
   equal darts.  Only darts up to a rank that fills all coordinates are
   thrown, about k log k a document however many shingles it has.  Each
   coordinate keeps its earliest dart.
2. Documents with equal shingle sets are one node; hot copies fold on the map
   side and never meet.
3. Nodes join by band.  In a band bucket of up to ``SMALL`` nodes all pairs
   are candidates; in a larger one every node meets the bucket's smallest.
4. Candidates pass a sketch of the signature (one byte a coordinate), then the
   exact Jaccard similarity of their shingles.
5. Links make components.  In large buckets that still hold several
   components, every node outside the bucket's largest one meets all others,
   block against block inside tasks: by sketch, then the likely pairs that
   nothing joins yet by their shingles, best first.  A task returns the links
   that join components, at most one a node, never its pairs.

The class of a document is the smallest doc_id of its component.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnwise.llm.common import arrow_job, free, stage, text_or_empty
from churnwise.llm.components import components
from churnwise.llm.textkit import U, mix, runs, shingles, words

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
#: Nodes of a bucket up to which all its pairs are candidates.
SMALL = 16
#: Share of equal sketch coordinates below which a candidate is dropped: over four deviations under 0.8.
LEAST_EQUAL = 0.66
#: Nodes of the two sides of a block when large buckets are compared.
SIDE_A, SIDE_B = 512, 1024
#: Darts thrown at once per region after the first.
BLOCK = 16
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def regions(h: np.ndarray, doc: np.ndarray, weight: np.ndarray):
    """Unit cells of the weighted elements: (cell hash, document, height of the cell up to 1)."""
    n = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(h)), n)
    c = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return mix(h[at] + U(0xD1B54A32D192ED03) * (c.astype(U) + U(1))), doc[at], np.minimum(1.0, weight[at] - c)


def dart_signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) array: per coordinate the earliest dart (rank bits and dart id); EMPTY for documents without weight."""
    sig = np.full(n_docs * k, EMPTY, U)
    cell, at, height = regions(h, doc, weight)
    total = np.bincount(at, height, n_docs)
    reach = k * (math.log(k) + 2.0) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        mine = todo[at]
        _throw(sig, cell[mine], at[mine], height[mine], reach, k)
        todo &= (sig.reshape(n_docs, k) == EMPTY).any(axis=1)
        reach = np.where(todo, reach * 2, reach)
    return sig.reshape(n_docs, k)


def _throw(sig, cell, doc, height, reach, k) -> None:
    rank = np.zeros(len(cell))
    thrown, size = 0, 1
    while len(cell):
        number = np.arange(thrown + 1, thrown + size + 1, dtype=U)
        dart = mix(cell[:, None] + number[None, :] * U(0x9E3779B97F4A7C15))
        ranks = rank[:, None] - np.cumsum(np.log(_uniform(dart)), axis=1)
        inside = ranks <= reach[doc][:, None]
        more = inside[:, -1]
        i, j = np.nonzero(inside)
        d = mix(dart[i, j] + U(1))
        hit = _uniform(mix(d + U(2))) <= height[i]
        i, j, d = i[hit], j[hit], d[hit]
        value = (ranks[i, j].astype(np.float32).view(np.uint32).astype(U) << U(32)) | (d & U(0xFFFFFFFF))
        np.minimum.at(sig, doc[i] * k + ((d >> U(32)) % U(k)).astype(np.int64), value)
        rank, cell, doc, height = ranks[more, -1], cell[more], doc[more], height[more]
        thrown += size
        size = BLOCK


def distinct_shingles(texts: pa.Array, n: int = WORDS):
    """(hash, document, count) of each document's distinct shingles, in document order."""
    h, d = shingles(words(texts), n)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    at = runs(d, h)
    return h[at], d[at], np.diff(at, append=len(h))


def _prints(weights: str):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = piece.column(1)
        n = len(texts)
        h, d, c = distinct_shingles(texts)
        w = c.astype(float) if weights == "count" else np.ones(len(c))
        sig = dart_signatures(h, d, w, n, BANDS * ROWS)
        total = np.zeros(n, U)
        np.add.at(total, d, mix(h + (c.astype(U) if weights == "count" else U(1))))
        size = np.bincount(d, w, n).astype(np.int64)
        node = mix(total + size.astype(U)).view(np.int64)
        band = np.zeros((n, BANDS), U)
        parts = mix(sig).reshape(n, BANDS, ROWS)
        for r in range(ROWS):
            band = mix(band * U(31) + parts[:, :, r] + U(r))
        band = mix(band + np.arange(BANDS, dtype=U)[None, :])
        has = size > 0
        sketch = np.ascontiguousarray((mix(sig) & U(255)).astype(np.uint8))
        offsets = np.cumsum(np.append(0, np.where(has, BANDS, 0)))
        return pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(2), pa.array(np.where(has, node, 0), mask=~has), pa.array(size),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band[has].ravel().view(np.int64))),
             pa.array([row.tobytes() for row in sketch], pa.binary())],
            names=["doc_id", "text_hash", "node", "size", "bands", "sketch"])
    return run


def fingerprints(docs: DataFrame, weights: str = "set") -> DataFrame:
    """One row per input row: doc_id, text_hash, node (null without words), size, bands, sketch."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    d = d.withColumn("text_hash", F.xxhash64("text"))
    return d.mapInArrow(arrow_job(_prints(weights)), "doc_id long, text_hash long, node long, size long, bands array<long>, sketch binary")


def _ratio(a: str, b: str) -> F.Column:
    return F.least(a, b) >= F.greatest(a, b) * THRESHOLD


def _bucket_pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of buckets; ``rows`` are (key, node, size)."""
    heads = (rows.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("node", "size")).alias("head"))
             .filter("m > 1"))
    lead = (rows.join(heads.select("key", F.col("head.node").alias("a"), F.col("head.size").alias("a_size")), "key")
            .filter((F.col("node") != F.col("a")) & _ratio("size", "a_size"))
            .select("a", F.col("node").alias("b")))
    small = rows.join(heads.filter(F.col("m").between(3, SMALL)).select("key"), "key", "left_semi")
    left = small.select("key", F.col("node").alias("a"), F.col("size").alias("a_size"))
    right = small.select("key", F.col("node").alias("b"), F.col("size").alias("b_size"))
    # at most SMALL partners for a row, whatever the input
    all_pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & _ratio("a_size", "b_size")).select("a", "b")
    return lead.unionAll(all_pairs).distinct()


def _similar(weights: str):
    """Keeps pairs whose texts have a shingle similarity of at least the threshold."""
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        n = piece.num_rows
        ha, da, ca = distinct_shingles(piece.column(2))
        hb, db, cb = distinct_shingles(piece.column(3))
        h, d = np.concatenate([ha, hb]), np.concatenate([da, db])
        c = np.concatenate([ca, cb]) if weights == "count" else np.ones(len(h), np.int64)
        order = np.lexsort((h, d))
        h, d, c = h[order], d[order], c[order]
        same = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
        both = np.bincount(d[same], np.minimum(c[same], c[same + 1]), n)
        union = np.bincount(d, c, n) - both
        ok = np.flatnonzero((union > 0) & (both >= THRESHOLD * union - 1e-9))
        return piece.select([0, 1]).take(pa.array(ok))
    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, weights: str) -> DataFrame:
    """Pairs whose sketches and then whose texts are similar enough; ``nodes`` has one document for each node."""
    def of(side):
        return nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"{side}_sketch"))

    def sketch(piece):
        a = np.frombuffer(b"".join(piece.column(2).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        b = np.frombuffer(b"".join(piece.column(3).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        return piece.select([0, 1]).take(pa.array(np.flatnonzero((a == b).mean(axis=1) >= LEAST_EQUAL)))
    near = stage(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_sketch", "b_sketch")
                 .mapInArrow(arrow_job(sketch, "a_sketch"), "a long, b long"), "near-pairs")
    texts = _texts(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs)
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return stage(near.join(ta, "a").join(tb, "b").select("a", "b", "a_text", "b_text")
                 .mapInArrow(arrow_job(_similar(weights), "a_text"), "a long, b long"), "near-links")


def _texts(used: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes ``used``: the text of each one's document."""
    picked = nodes.join(used, "node", "left_semi").select("node", "doc_id", "text_hash")
    d = docs.select(F.col("doc_id").cast("long").alias("t_id"), text_or_empty().alias("text"))
    d = d.withColumn("t_hash", F.xxhash64("text"))
    return (d.join(picked, d.t_id.eqNullSafe(picked.doc_id) & (d.t_hash == picked.text_hash))
            .dropDuplicates(["node"]).select("node", "text"))


def near_duplicates(docs: DataFrame, weights: str = "set") -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its component), class_size, kept, text_hash.

    Null texts and texts without a word have no shingle: each is a class of
    its own and kept.  A text of one to four words is one shingle.  Rows that
    repeat a doc_id are rows of their own; null ids are never the smallest,
    and a class of null ids alone has class_id null and is kept.  Very long
    texts are handled whole.  An empty table gives an empty result.  Columns
    other than doc_id and text are not read.
    """
    prints = stage(fingerprints(docs, weights), "near-prints")
    nodes = stage(prints.filter("node IS NOT NULL").groupBy("node")
                  .agg(F.min(F.struct("doc_id", "text_hash", "size", "sketch", "bands")).alias("r"))
                  .select("node", "r.doc_id", "r.text_hash", "r.size", "r.sketch", "r.bands"), "near-nodes")
    rows = nodes.select("node", "size", F.explode("bands").alias("key"))
    links = _verified(_bucket_pairs(rows), nodes, docs, weights)
    found = components(links, "near")
    found = stage(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "near-roots")
    big = rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > SMALL).select("key")
    large = stage(rows.join(big, "key", "left_semi"), "near-large")
    more = _across(nodes, large, found, docs, weights)
    if more is not None:
        found = _joined(found, more)
    label = prints.select("doc_id", "text_hash", "node").join(found, "node", "left")
    # documents without words stay alone, each under a key of its own
    alone = F.col("node").isNull()
    d = label.select("doc_id", "text_hash", alone.alias("alone"), F.coalesce("root", "node").alias("root"))
    least = (d.filter(~F.col("alone")).groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return (d.join(least, "root", "left")
            .select("doc_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(F.col("alone"), F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
                    (F.col("alone") | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), "text_hash"))


def first_of_classes(docs: DataFrame, weights: str = "set") -> DataFrame:
    """The rows of ``docs`` that stay: one for each class, whole and with all columns."""
    stay = (near_duplicates(docs, weights).filter("kept")
            .select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash")))
    names = docs.columns
    h, place = free("near_hash", names), free("near_place", names)
    d = docs.withColumn(h, F.xxhash64(text_or_empty()))
    d = d.join(stay, d["doc_id"].cast("long").eqNullSafe(stay["s_id"]) & (d[h] == stay["s_hash"]), "left_semi")
    # rows that repeat both id and text: any one of them
    w = Window.partitionBy("doc_id", h).orderBy("doc_id")
    return d.withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).select(*names)


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after ``links``: only the roots that they touch are contracted."""
    a = found.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = found.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    merged = components(links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")), "near-more")
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return stage(found.join(merged, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "near-roots")


def _across(nodes: DataFrame, large: DataFrame, found: DataFrame, docs: DataFrame, weights: str) -> DataFrame | None:
    """Links (a, b) that join components which share a large bucket; None where no bucket holds two."""
    labelled = large.join(found, "node")
    per_root = labelled.groupBy("key", "root").agg(F.count("*").alias("c"))
    most = F.max(F.struct("c", "root"))
    mixed = stage(per_root.groupBy("key").agg(most.alias("most"), F.sum("c").alias("m"), F.count("*").alias("roots"))
                  .filter("roots > 1").select("key", F.col("most.root").alias("main"), "m", (F.col("m") - F.col("most.c")).alias("out")), "near-mixed")
    if mixed.isEmpty():
        return None
    d = stage(labelled.join(mixed, "key").withColumn("a_blocks", F.ceil(F.col("out") / SIDE_A).cast("int"))
              .withColumn("b_blocks", F.ceil(F.col("m") / SIDE_B).cast("int")), "near-members")
    whole = nodes.select("node", "sketch", "bands").join(_texts(d.select("node").distinct(), nodes, docs), "node")
    whole = stage(whole, "near-whole")
    cols = ["key", "ab", "bb", "side", "node", "root"]
    outside = (d.filter("root <> main").withColumn("ab", F.pmod(F.xxhash64("node"), F.col("a_blocks")).cast("int"))
               .withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1))).withColumn("side", F.lit(0)).select(cols))
    everyone = (d.withColumn("bb", F.pmod(F.xxhash64("node", F.lit(1)), F.col("b_blocks")).cast("int"))
                .withColumn("ab", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).withColumn("side", F.lit(1)).select(cols))
    return stage(outside.unionAll(everyone).join(whole, "node").groupBy("key", "ab", "bb")
                 .applyInPandas(_linking(weights), "a long, b long"), "near-across")


def _linking(weights: str):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between side 0 and side 1 that join components, found by sketch and proved by shingles."""
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, BANDS * ROWS)
        node, root, side = (pdf[c].to_numpy() for c in ("node", "root", "side"))
        bands = np.array(pdf["bands"].tolist(), np.int64)
        sets = []
        for lo in range(0, len(pdf), 256):
            h, d, c = distinct_shingles(pa.array(pdf["text"].iloc[lo: lo + 256]))
            c = c if weights == "count" else np.ones(len(h), np.int64)
            at = np.searchsorted(d, np.arange(min(256, len(pdf) - lo) + 1))
            sets += [(h[i:j], c[i:j], int(c[i:j].sum())) for i, j in zip(at[:-1], at[1:])]
        parent: dict = {}

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        def similar(i, j):
            (hi, ci, ni), (hj, cj, nj) = sets[i], sets[j]
            if min(ni, nj) < THRESHOLD * max(ni, nj):
                return False
            _, p, q = np.intersect1d(hi, hj, assume_unique=True, return_indices=True)
            both = int(np.minimum(ci[p], cj[q]).sum())
            return both >= THRESHOLD * (ni + nj - both) - 1e-9
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        for lo in range(0, len(a), 64):
            x = a[lo: lo + 64]
            equal = np.zeros((len(x), len(b)), np.int16)
            for c in range(BANDS * ROWS):
                equal += sketch[x, c][:, None] == sketch[b, c][None, :]
            i, j = np.nonzero((equal >= LEAST_EQUAL * BANDS * ROWS) & (root[x][:, None] != root[b][None, :]))
            # a pair is handled in the first bucket that it shares; were that a small one, it has been compared there
            shared = (bands[x[i]] == bands[b[j]]).argmax(axis=1) if len(i) else i
            mine = bands[x[i], shared] == key[0]
            i, j = i[mine], j[mine]
            for k in np.argsort(-equal[i, j], kind="stable"):
                p, q = x[i[k]], b[j[k]]
                rp, rq = top(root[p]), top(root[q])
                if rp != rq and similar(p, q):
                    parent[rq] = rp
                    out.append((node[p], node[q]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run
