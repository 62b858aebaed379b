"""Exact dedup: an extendible-hash index whose buckets are files in the shared folder.

1. Every text is normalised and fingerprinted (64-bit key, SHA-256) in the JVM.
2. The directory starts at depth 0 and doubles while a bucket of distinct keys
   is overfull and may still split.  It is built from a histogram of key
   prefixes, at most ``2 ** MAX_DEPTH`` numbers whatever the input.
3. Map tasks combine equal texts of a batch, then rows go to the owner task of
   their bucket, a range of keys.  The owner streams its rows in key order,
   chains the different texts of one key, compares their bytes, and writes
   the index entries (key, chain place, keep_id, group_size) as bucket files.
4. Documents look up their entry by key and digest.

A text that a third of all rows share reaches its owner once per map batch,
and the lookup join is split by AQE, so no group is gathered anywhere.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnwise.llm.common import WS, free, stage, text_or_empty

#: Bytes of distinct texts that a bucket holds before it splits, and that an owner task gets on average.
BUCKET_BYTES, OWNER_BYTES = 1 << 20, 64 << 20
#: Largest directory: 2 ** MAX_DEPTH entries.
MAX_DEPTH = 18

ENTRY = "bucket int, key long, sha binary, keep_id long, group_size long"


def fingerprints(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(doc_id, key, sha, norm).  ``hash_bits`` below 64 makes keys collide (tests use it)."""
    norm = F.regexp_replace(text_or_empty(), f"{WS}+", " ")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    key = F.xxhash64("norm")
    if hash_bits < 64:
        key = F.shiftleft(key, 64 - hash_bits)
    return d.select("doc_id", key.alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")


def split_directory(cells: dict[int, int], depth: int, capacity: int) -> list[int]:
    """Bucket number of each of the ``2 ** depth`` directory entries.

    Buckets start as the whole key space; an overfull bucket splits into its
    two halves until it fits or a single directory entry remains.
    """
    out, todo, buckets = [0] * (1 << depth), [(0, 1 << depth)], 0
    sums = [0]
    for i in range(1 << depth):
        sums.append(sums[-1] + cells.get(i, 0))
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1 and sums[hi] - sums[lo] > capacity:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
            continue
        out[lo:hi] = [buckets] * (hi - lo)
        buckets += 1
    return out


def directory(fp: DataFrame, capacity: int) -> tuple[DataFrame, int, int]:
    """(prefix -> bucket table, depth, bytes of all keys) for the fingerprints ``fp`` (key, n_bytes)."""
    spark = fp.sparkSession
    keys = fp.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"))
    top = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    full = stage(keys.groupBy(top.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")), "exact-cells")
    total = full.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total / capacity))) + 3))
    rows = (full.groupBy(F.shiftright("cell", MAX_DEPTH - depth).alias("cell")).agg(F.sum("n_bytes").alias("n"))
            .collect())                                     # 2 ** depth numbers at most
    entries = split_directory({r["cell"]: r["n"] for r in rows}, depth, capacity)
    table = spark.createDataFrame(list(enumerate(entries)), "cell int, bucket int")
    return table, depth, total


def _combine(batches):
    """Map side: equal texts of a batch become one row."""
    for batch in batches:
        seen: dict = {}
        for bucket, key, sha, norm, doc_id in zip(*(batch.column(i).to_pylist() for i in range(5))):
            at = seen.get((key, norm))
            if at is None:
                seen[key, norm] = [bucket, key, sha, norm, doc_id, 1]
            else:
                at[5] += 1
                if doc_id is not None and (at[4] is None or doc_id < at[4]):
                    at[4] = doc_id
        cols = list(zip(*seen.values())) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()))],
            names=["bucket", "key", "sha", "norm", "keep_id", "n"])


def _owner(batches):
    """Owner task: rows arrive by (bucket, key); the chain of one key is all that is held."""
    chain_of, chain = None, []          # chain entries: [bucket, key, sha, keep_id, n, text]
    out: list = []

    def flush():
        cols = list(zip(*out)) if out else [[]] * 5
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))],
            names=["bucket", "key", "sha", "keep_id", "group_size"])
        out.clear()
        return batch

    for batch in batches:
        for bucket, key, sha, norm, keep, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if key != chain_of:
                out.extend(e[:5] for e in chain)
                chain_of, chain = key, []
            for e in chain:
                if e[5] == norm:        # same bytes: same group; else a collision, which chains
                    e[4] += n
                    if keep is not None and (e[3] is None or keep < e[3]):
                        e[3] = keep
                    break
            else:
                chain.append([bucket, key, sha, keep, n, norm])
        yield flush()
    out.extend(e[:5] for e in chain)
    yield flush()


def build_index(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows, index entries), both as files in the shared folder."""
    fp = fingerprints(docs, hash_bits)
    prints = stage(fp.select("doc_id", "key", "sha", F.octet_length("norm").alias("n_bytes")), "exact-prints")
    table, depth, total = directory(prints, bucket_bytes)
    cell = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
    # the directory has at most 2 ** MAX_DEPTH pairs of integers, so it may be broadcast
    rows = (fp.withColumn("cell", cell).join(F.broadcast(table), "cell")
            .select("bucket", "key", "sha", "norm", "doc_id"))
    spark = docs.sparkSession
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // OWNER_BYTES)
    entries = (rows.mapInArrow(_combine, "bucket int, key long, sha binary, norm string, keep_id long, n long")
               .repartition(owners, "bucket").sortWithinPartitions("bucket", "key")
               .mapInArrow(_owner, ENTRY))
    return prints, stage(entries, "exact-index")


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and so group together; very long texts are
    compared whole.  Rows that repeat a doc_id are rows of their own (all
    with that id are kept if it is the smallest of the group).  Null ids are
    never the smallest; a group of null ids alone has keep_id null and is kept.  An empty table gives an empty result.  Other columns
    of ``docs`` are not read, so their names cannot clash.
    """
    prints, entries = build_index(docs, bucket_bytes, hash_bits)
    e = entries.select("key", "sha", "keep_id", "group_size")
    return (prints.select("doc_id", "key", "sha").join(e, ["key", "sha"])
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def first_copies(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay: one for each text, whole and with all columns."""
    _, entries = build_index(docs, bucket_bytes)
    names = docs.columns
    k, s, place = (free(x, names) for x in ("dedup_key", "dedup_sha", "dedup_place"))
    norm = F.regexp_replace(text_or_empty(), f"{WS}+", " ")
    d = docs.withColumns({k: F.xxhash64(norm), s: F.unhex(F.sha2(norm, 256))})
    e = entries.select(F.col("key").alias("e_key"), F.col("sha").alias("e_sha"), F.col("keep_id").alias("e_keep"))
    stay = d.join(e, (d[k] == e["e_key"]) & (d[s] == e["e_sha"]) & d["doc_id"].cast("long").eqNullSafe(e["e_keep"]), "left_semi")
    # rows that repeat both id and text: any one of them
    w = Window.partitionBy(k, s).orderBy("doc_id")
    return stay.withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).select(*names)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
