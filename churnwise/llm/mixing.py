"""Mixing sources to target weights, by fixed-length token blocks.

1. Each source's words are laid out document after document, in the order of
   an id hash, and cut into blocks of ``BLOCK`` words (the last one of a
   source may be shorter).  Running sums are taken per hash bucket and then
   over bucket totals, so no source is gathered in one task.
2. Targets share all words by weight; a source that would pass ``MAX_EPOCHS``
   times its size stops there and its excess is reshared.
3. A source's slots (blocks to take) are dealt over the output shards by a
   multinomial draw whose sum is the source's quota.
4. A slot maps to a block index by a pseudorandom permutation of the source's
   blocks per epoch, so a block is taken again only after all others.
5. Slots and document segments join on (source, block index).

Draws and permutations are seeded by source and ``seed``: reruns agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnwise.llm.common import NOT_WS, arrow_job, free, stage, text_or_empty
from churnwise.llm.textkit import IS_WS, mix

#: Words of a block.
BLOCK = 64
#: Rows that one bucket of the layout holds on average, and the fewest buckets.
BUCKET_ROWS, MIN_BUCKETS = 50_000, 64
#: Slots of one output shard on average.
SHARD_SLOTS = 20_000
#: A source is taken at most so many times over.
MAX_EPOCHS = 3
#: FIXED VALUE: weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_WS}+")).cast("long")


def share_targets(sizes: list[int], weights: list[float], cap: float = MAX_EPOCHS) -> list[float]:
    """Targets that share ``sum(sizes)`` by weight, none above ``cap`` times its size.

    Sources above their cap stop at it and leave; the rest reshares what
    remains by weight until none is above.
    """
    target, left = [0.0] * len(sizes), float(sum(sizes))
    live = [i for i, s in enumerate(sizes) if s > 0]
    while live:
        total = sum(weights[i] for i in live)
        over = [i for i in live if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in live:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left -= sum(target[i] for i in over)
        live = [i for i in live if i not in set(over)]
    return target


def source_plan(sources: DataFrame, seed: int) -> DataFrame:
    """(source, size) -> + target, blocks, quota.  One row per source; the number of sources is small by nature."""
    rows = sources.select("source", "size").collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))       # code points, null last
    sizes = [int(r["size"]) for r in rows]
    targets = share_targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    out = []
    for r, size, target in zip(rows, sizes, targets):
        blocks = -(-size // BLOCK)
        quota = min(MAX_EPOCHS * blocks, round(target * blocks / size)) if size else 0
        out.append((r["source"], size, target, blocks, quota))
    return sources.sparkSession.createDataFrame(
        out, "source string, source_size long, target double, blocks long, quota long")


def _seed(source: str | None, seed: int, *more: int) -> int:
    """A 64-bit key from the source's bytes, the seed and further numbers."""
    text = b"\x00" if source is None else b"s" + source.encode("utf-8")
    digest = hashlib.blake2b(text + repr((seed, *more)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") >> 1


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: four Feistel rounds, walked until the value is below ``n``."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [mix(np.array([key + i], np.uint64))[0] for i in range(1, 5)]
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo[todo] = x[todo] >= np.uint64(n)
    return x.astype(np.int64)


def _shard_counts(seed: int, shards: int):
    """Multinomial counts of each source per output shard, as slot ranges; the counts of a source sum to its quota."""
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                source = None if r.source is None or r.source != r.source else r.source
                rng = np.random.default_rng(_seed(source, seed))
                count = rng.multinomial(int(r.quota), np.full(shards, 1.0 / shards))
                start = np.cumsum(count) - count
                has = count > 0
                yield pd.DataFrame({"source": source, "blocks": int(r.blocks), "shard": np.flatnonzero(has).astype("int32"),
                                    "start": start[has], "slots": count[has]})
    return run


def _slot_blocks(seed: int):
    """Block index of every slot of a (source, shard)."""
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                source = None if r.source is None or r.source != r.source else r.source
                slot = np.arange(int(r.start), int(r.start) + int(r.slots))
                epoch, i = slot // int(r.blocks), slot % int(r.blocks)
                block = np.empty_like(slot)
                for e in np.unique(epoch):
                    at = epoch == e
                    block[at] = permuted(i[at], int(r.blocks), _seed(source, seed, int(e)))
                yield pd.DataFrame({"source": source, "block": block})
    return run


def draw_blocks(plan: DataFrame, seed: int = 0) -> DataFrame:
    """(source, block, times): how often the mix takes each block."""
    total = plan.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_SLOTS))
    ranges = plan.filter("quota > 0").select("source", "blocks", "quota").mapInPandas(
        _shard_counts(seed, shards), "source string, blocks long, shard int, start long, slots long")
    spark = plan.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards, 1 << 14))
    slots = (ranges.repartition(tasks, "source", "shard")
             .mapInPandas(_slot_blocks(seed), "source string, block long"))
    return slots.groupBy("source", "block").agg(F.count("*").alias("times"))


def layout(sized: DataFrame) -> DataFrame:
    """Adds ``offset``: words of the source that come before the document (order: bucket by the hash of id and text, id, text hash)."""
    n = sized.agg(F.count("*")).first()[0]
    buckets = max(MIN_BUCKETS, -(-n // BUCKET_ROWS))
    d = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(buckets)).cast("int"))
    base = (d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
            .withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
            .drop("words"))
    w = Window.partitionBy("source", "bucket").orderBy("doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("before", F.sum("size").over(w) - F.col("size"))
    base = base.withColumnRenamed("source", "b_source").withColumnRenamed("bucket", "b_bucket")
    return (d.join(base, d.source.eqNullSafe(base.b_source) & (d.bucket == base.b_bucket))
            .withColumn("offset", F.col("before") + F.col("base")).drop("b_source", "b_bucket", "base", "before", "bucket"))


def _sized(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(text).alias("size"), F.xxhash64(text).alias("row_hash"))


def taken_segments(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents with source, size, offset, row_hash; plan).  Both are staged."""
    sized = stage(_sized(docs), "mix-sizes")
    laid = stage(layout(sized), "mix-layout")
    plan = source_plan(laid.groupBy("source").agg(F.sum("size").alias("size")), seed)
    return laid, plan


def _segments(laid: DataFrame, times: DataFrame) -> DataFrame:
    """One row per document and block it has words in: first word, words, times (0: not taken)."""
    first, last = F.floor(F.col("offset") / BLOCK), F.floor((F.col("offset") + F.col("size") - 1) / BLOCK)
    seg = (laid.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last))
                                              .otherwise(F.array(F.lit(-1).cast("long")))))
           .withColumn("word", F.greatest(F.col("block") * BLOCK, F.col("offset")) - F.col("offset"))
           .withColumn("words", F.when(F.col("block") < 0, 0).otherwise(
               F.least(F.col("block") * BLOCK + BLOCK, F.col("offset") + F.col("size"))
               - F.greatest(F.col("block") * BLOCK, F.col("offset")))))
    # Spark judges the blocks' size by the plan's few rows; they grow with the corpus and must not be broadcast
    t = times.select(F.col("source").alias("t_source"), F.col("block").alias("t_block"), "times").hint("merge")
    return (seg.join(t, seg.source.eqNullSafe(t.t_source) & (seg.block == t.t_block), "left")
            .drop("t_source", "t_block").withColumn("times", F.coalesce("times", F.lit(0).cast("long"))))


def mix_sources(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source.

    Null or empty texts have size 0 and are taken 0 times; a null source is a
    source of its own, last in order; a source without words has target 0.
    Rows that repeat an id are rows of their own; equal rows may swap their
    places, which changes no figure but which of them is taken.  A document
    longer than a block spans several blocks, whatever its length.  An empty
    table gives an empty result.  Columns other than doc_id, text and source
    are not read.
    """
    laid, plan = taken_segments(docs, seed)
    seg = _segments(laid, draw_blocks(plan, seed))
    per_doc = _sum_rows(seg)
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target")
    # the plan has one row per source
    return (per_doc.join(p, per_doc.source.eqNullSafe(p.p_source))
            .select("doc_id", "size", "source_size", "target", "taken", "source"))


def _sum_rows(seg: DataFrame) -> DataFrame:
    """Segments back to documents.  Offset, size, id and text hash tell rows apart; rows equal in all are empty copies."""
    g = (seg.groupBy("doc_id", "source", "size", "offset", "row_hash")
         .agg(F.sum(F.col("words") * F.col("times")).cast("long").alias("taken"),
              F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).cast("int").alias("copies")))
    return g.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).drop("copy", "copies")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as documents: columns of ``docs``; a row per document and round in which words of it are taken.

    Round r holds the words whose block is taken r times or more, in text
    order, so the words of a document's rows sum to its ``taken``.  Null and
    empty texts are never taken; of rows that repeat id and text each stands
    for itself; an empty table gives none; extra columns stay as they are.
    """
    laid, plan = taken_segments(docs, seed)
    seg = _segments(laid, draw_blocks(plan, seed)).filter("times > 0")
    cuts = (seg.groupBy("doc_id", "source", "offset", "row_hash")
            .agg(F.array_sort(F.collect_list(F.struct("word", "words", "times"))).alias("cuts")))
    # equal rows have different offsets: the k-th of them in offset order gets the k-th row
    w = Window.partitionBy("doc_id", "source", "row_hash")
    cuts = cuts.withColumn("copy", F.row_number().over(w.orderBy("offset"))).drop("offset")
    names, schema = docs.columns, docs.schema
    # the documents' own columns travel inside a struct, so no name of theirs meets one used here
    d = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc"), F.col("doc_id").cast("long").alias("d_id"),
                    F.col("source").cast("string").alias("d_source"), F.xxhash64(text_or_empty()).alias("d_hash"))
    d = d.withColumn("d_copy", F.row_number().over(Window.partitionBy("d_id", "d_source", "d_hash").orderBy("d_id")))
    c = cuts.select(F.col("doc_id").alias("c_id"), F.col("source").alias("c_source"), "row_hash", F.col("copy").alias("c_copy"), "cuts")
    joined = d.join(c, d.d_id.eqNullSafe(c.c_id) & d.d_source.eqNullSafe(c.c_source) & (d.d_hash == c.row_hash) & (d.d_copy == c.c_copy))
    return joined.select("doc.*", F.col("cuts").alias(free("cuts", names))).mapInArrow(arrow_job(_cut(names, schema)), schema)


def _cut(names, schema):
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts = [], []
        for i, (text, cuts) in enumerate(zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())):
            raw = np.frombuffer(b" " + (text or "").encode("utf-8") + b" ", np.uint8)
            turn = np.flatnonzero(np.diff(IS_WS[raw].astype(np.int8)))
            starts = turn[0::2]                       # byte of each word's start in the text
            data = (text or "").encode("utf-8")
            ends = [*starts[1:].tolist(), len(data)]
            for r in range(1, MAX_EPOCHS + 1):
                part = [data[starts[c["word"]]: ends[c["word"] + c["words"] - 1]] for c in cuts if c["times"] >= r]
                if part:
                    rows.append(i)
                    texts.append(b"".join(p if p[-1:].isspace() else p + b" " for p in part).decode("utf-8").rstrip(" "))
        taken = batch.select(range(len(names))).take(pa.array(rows, pa.int64()))
        cols = list(taken.columns)
        cols[at] = pa.array(texts, taken.schema.field(at).type)
        if chars is not None:
            cols[chars] = pa.array([len(t) for t in texts], taken.schema.field(chars).type)
        return pa.RecordBatch.from_arrays(cols, names=names)
    return run
