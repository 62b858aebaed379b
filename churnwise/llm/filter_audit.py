"""Filter interaction audit: which of five quality filters removes what, in every order.

1. ``term_matrix`` builds a sparse document-term matrix.  A task reads its
   documents in pieces of about ``SHARD_BYTES`` of text and makes each piece a
   CSR shard over the piece's own word codes, numbered by hash range.  The
   shard's distinct words of one range go to that range's owner as one row;
   the owner numbers the words it has not met and sends the numbers back, in
   the same order.  A word is met once per shard that holds it, so no word
   gathers more than any other common one, and nothing is broadcast.
2. Row sums (words) and nonzero counts (distinct words) of the shards decide
   filters A and B; C and D are expressions over the text; E compares a
   document's id with the smallest id of its text, found by text digest.
3. Documents fold to counts per (part, set of failed filters, label), at most
   128 rows a part, and every figure of the 120 orders is a sum over those.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import slices, stage, text_or_empty
from churnwise.llm.textkit import runs as starts_of
from churnwise.llm.textkit import split_words
from churnwise.llm.textkit import words as hashed_words

#: Text bytes of a CSR shard (one document at least).
SHARD_BYTES = 2 << 20
#: Text bytes for each hash range of the dictionary, and the fewest ranges (a power of two): an owner holds a range's distinct words.
RANGE_BYTES, MIN_RANGES = 256 << 20, 64
#: FIXED VALUES: limits of the five filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
FILTERS = "ABCDE"


# ---- the matrix ---------------------------------------------------------

def csr(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(indptr, codes, counts, words, ranges): a row per text, ascending codes into ``words``, which holds each word once.

    Words are in the order of their hash range, the first ``bits`` bits of the word's hash.
    """
    values, first = split_words(texts)
    coded = values.dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    del values, coded
    ranges = (hashed_words(words).hash >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(ranges, kind="stable")
    renumbered = np.empty(len(words), np.int32)
    renumbered[order] = np.arange(len(words))
    width = max(1, len(words))
    key = np.repeat(np.arange(len(first) - 1) * width, np.diff(first))
    key += renumbered[codes]
    del codes
    key.sort()
    new = np.flatnonzero(np.diff(key, prepend=-1))
    row, code = key[new] // width, key[new] % width
    indptr = np.searchsorted(row, np.arange(len(first)))
    return indptr, code, np.diff(new, append=len(key)), words.take(pa.array(order)), ranges[order]


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Numbers below 2^32 as four compressed byte planes, of their differences if ``delta``."""
    v = values.astype(np.uint32)
    if delta:
        v = np.diff(v, prepend=v[:1] * 0)
    return pa.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int, delta: bool = False) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    v = np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)
    return (np.cumsum(v, dtype=np.uint32) if delta else v).astype(np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0] + [len(a) for a in arrays])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


LOCAL = T.StructType([T.StructField("shard", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("words", T.StringType()),
                      T.StructField("entries", T.LongType()), T.StructField("indptr", T.ArrayType(T.IntegerType())),
                      T.StructField("codes", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def _local_shards(keep: list[str], bits: int):
    """Pieces of (part, text, kept columns) to a row per shard, without range, over the shard's own codes, and a row per cell.

    A cell holds the shard's words of one hash range, in the order of their
    codes, joined by a space (no word has one).  In the shard's row the kept
    columns are arrays, a value per document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for piece in slices(batches, limit=SHARD_BYTES):
            shard = (piece.column("part")[0].as_py() << 33) + n
            indptr, codes, counts, words, ranges = csr(piece.column("text"), bits)
            at = starts_of(ranges)
            grouped = pa.ListArray.from_arrays(pa.array(np.append(at, len(ranges)), pa.int32()), words)
            cells = pc.binary_join(grouped, pa.scalar(" ", pa.large_string())).cast(pa.string())
            nothing = [pa.nulls(len(at), f) for f in (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary())]
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(at), pa.int64()), pa.array(ranges[at], pa.int32()), cells, *nothing,
                     *[pa.nulls(len(at), pa.list_(piece.column(k).type)) for k in keep]], [*LOCAL.names, *keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([len(codes)], pa.int64()),
                 _lists([indptr], pa.int32()), pa.array([pack(codes, delta=True)], pa.binary()), pa.array([pack(counts)], pa.binary()),
                 *[pa.ListArray.from_arrays([0, piece.num_rows], piece.column(k)) for k in keep]], [*LOCAL.names, *keep])
            n += 1
            pa.default_memory_pool().release_unused()
    return run


def _owned(batches: Iterator[pa.RecordBatch], words_out: bool) -> Iterator[pa.RecordBatch]:
    """Cells sorted by (range, shard) to (shard, range, ranks), or to (range, rank, word) of each word when it is first met.

    The order of the cells fixes the ranks, so a task that runs again gives the same.
    """
    current, seen = None, {}
    for batch in batches:
        shards, ranges, words = (batch.column(c).to_pylist() for c in ("shard", "range", "words"))
        out, fresh = [], []
        for r, text in zip(ranges, words):
            if r != current:
                current, seen = r, {}
            before = len(seen)
            out.append(np.array([seen.setdefault(w, len(seen)) for w in text.split(" ")], np.int32))
            if words_out and len(seen) > before:
                fresh += [(r, k, w) for w, k in itertools.islice(seen.items(), before, None)]
        if words_out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in fresh], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))],
                                             ["range", "rank", "word"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(ranges, pa.int32()), _lists(out, pa.int32())], ["shard", "range", "ranks"])


def _gathered(ranges: int):
    """(shard, range, ranks) sorted by (shard, range) to one array of ids per shard, in the order of its codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), _lists([np.concatenate(held)], pa.int64())], ["shard", "ids"])
        for batch in batches:
            keys, of, ranks = batch.column("shard").to_pylist(), batch.column("range").to_pylist(), batch.column("ranks")
            for i, key in enumerate(keys):
                if key != shard:
                    if held:
                        yield out()
                    shard, held = key, []
                held.append(ranks[i].values.to_numpy().astype(np.int64) * ranges + of[i])
        if held:
            yield out()
    return run


def _renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed local codes and counts to global ids and counts, a shard at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            n = row.column("entries")[0].as_py()
            codes, counts = unpack(row.column("codes")[0].as_py(), n, delta=True), unpack(row.column("counts")[0].as_py(), n)
            ids = row.column("ids").flatten().to_numpy()
            names = [c for c in row.schema.names if c not in ("codes", "counts", "ids", "entries")]
            yield pa.RecordBatch.from_arrays([_lists([ids[codes] if n else np.zeros(0, np.int64)], pa.int64()), _lists([counts], pa.int32()),
                                              *[row.column(c) for c in names]], ["indices", "counts", *names])


@dataclass
class TermMatrix:
    """``shards``: shard, indptr, indices (global word ids), counts and the kept columns as arrays, a row per CSR shard;
    ``vocabulary``: id, word and the number of documents that hold it; ``row_sums``: a row per document."""
    packed: DataFrame
    words: DataFrame
    named: dict[str, str]

    def _kept(self) -> list[T.StructField]:
        return [self.packed.schema[k] for k in self.named]

    @property
    def shards(self) -> DataFrame:
        out = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
                            T.StructField("shard", T.LongType()), T.StructField("indptr", T.ArrayType(T.IntegerType())), *self._kept()])
        return self.packed.mapInArrow(_renumber, out).select("shard", "indptr", "indices", "counts", *[F.col(k).alias(c) for k, c in self.named.items()])

    @property
    def vocabulary(self) -> DataFrame:
        held = self.shards.select(F.explode("indices").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("documents"))
        return self.words.join(held, "id").select("id", "word", "documents")

    @property
    def row_sums(self) -> DataFrame:
        """(words, distinct_words, kept columns): row sums and nonzero counts; a shard stays in its task, only its sums leave."""
        out = T.StructType([T.StructField("words", T.LongType()), T.StructField("distinct_words", T.LongType()),
                            *[T.StructField(f.name, f.dataType.elementType) for f in self._kept()]])
        return (self.packed.mapInArrow(lambda batches: _sums(_renumber(batches)), out)
                .select("words", "distinct_words", *[F.col(k).alias(c) for k, c in self.named.items()]))


def term_matrix(docs: DataFrame, keep: list[str] = ("doc_id",), text: str = "text") -> TermMatrix:
    """The documents' term matrix; ``keep`` names columns that stay beside the rows.

    Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, case-sensitive.  Null and
    empty texts are rows without entries; repeated rows are rows of their own.
    A very long text is a shard of its own.  An id is the word's rank in its
    hash range times the number of ranges, plus the range.
    """
    keep = list(keep)
    named = {f"kept_{i}": c for i, c in enumerate(keep)}
    source = docs.select(F.spark_partition_id().cast("long").alias("part"), text_or_empty(text).alias("text"),
                         *[F.col(f"`{c}`").alias(k) for k, c in named.items()])
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text)))).first()[0] or 0
    bits = (max(MIN_RANGES, -(-size // RANGE_BYTES)) - 1).bit_length()
    kept = [T.StructField(k, T.ArrayType(source.schema[k].dataType)) for k in named]
    local = stage(source.mapInArrow(_local_shards(list(named), bits), T.StructType([*LOCAL.fields, *kept])), "term-shards")
    cells = (local.filter("range IS NOT NULL").select("shard", "range", "words")
             .repartition("range").sortWithinPartitions("range", "shard"))
    ranks = cells.mapInArrow(lambda b: _owned(b, False), "shard long, range int, ranks array<int>")
    words = cells.mapInArrow(lambda b: _owned(b, True), "range int, rank int, word string")
    ids = (ranks.repartition("shard").sortWithinPartitions("shard", "range").mapInArrow(_gathered(1 << bits), "shard long, ids array<long>"))
    packed = (local.filter("range IS NULL").drop("range", "words").join(ids, "shard", "left")
              .select("codes", "entries", "ids", "counts", "shard", "indptr", *named))
    return TermMatrix(packed, words.select((F.col("rank").cast("long") * (1 << bits) + F.col("range")).alias("id"), "word"), named)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            indptr, counts = (row.column(c).flatten().to_numpy().astype(np.int64) for c in ("indptr", "counts"))
            ids = row.column("indices").flatten().to_numpy()
            total = np.concatenate([[0], np.cumsum(counts)])[indptr]
            doc = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
            order = np.lexsort((ids, doc))
            new = np.ones(len(ids), bool)
            new[1:] = (np.diff(ids[order]) != 0) | (np.diff(doc[order]) != 0)
            nonzero = np.bincount(doc[order][new], minlength=len(indptr) - 1)
            kept = [n for n in row.schema.names if n not in ("indptr", "counts", "indices", "shard")]
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(total), pa.int64()), pa.array(nonzero, pa.int64()),
                                              *[row.column(n).flatten() for n in kept]], ["words", "distinct_words", *kept])


# ---- the audit ----------------------------------------------------------

def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): documents by source, set of failed filters (bits of ABCDE, A lowest) and labels.

    A document is good or toxic if any of its label rows says so; documents
    without id or label are neither.  A null id is smaller and larger than
    none, so it neither fails E nor makes another fail.
    """
    t = text_or_empty()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), t.alias("text"),
                       F.sha2(t, 256).alias("digest"),
                       (F.length(F.regexp_replace(t, "[^A-Z]+", "")) * 100 > F.length(t) * CAPITAL_PERCENT).alias("c"),
                       t.rlike(r"[#$%&*|]").alias("d"))
    rows = term_matrix(rows, ["doc_id", "part", "digest", "c", "d"]).row_sums
    bits = ((F.col("words") < LEAST_WORDS).cast("int") + 2 * (100 * F.col("distinct_words") < DISTINCT_PERCENT * F.col("words")).cast("int")
            + 4 * F.col("c").cast("int") + 8 * F.col("d").cast("int"))
    # equal rows fold before any join, so a repeated id or text is a few rows
    folded = stage(rows.groupBy("doc_id", "part", "digest", bits.alias("failed")).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    nameless = folded.filter("doc_id IS NULL").groupBy("part", "failed").agg(F.sum("n").alias("n"))
    # a text's copies fold to one row per part and labels, with the smallest id and its rows, before they meet
    known = folded.filter("doc_id IS NOT NULL").join(marked, "doc_id", "left").na.fill(0, ["good", "toxic"])
    texts = known.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = texts.groupBy("digest").agg(F.min("least.doc_id").alias("first_id"))
    firsts = F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    halves = F.array(F.struct(F.col("failed").alias("f"), firsts.alias("m")), F.struct((F.col("failed") + 16).alias("f"), (F.col("n") - firsts).alias("m")))
    texts = texts.join(first, "digest").select("part", "good", "toxic", F.inline(halves)).filter("m > 0").groupBy(
        "part", F.col("f").alias("failed"), "good", "toxic").agg(F.sum("m").alias("n"))
    both = texts.unionByName(nameless.select("part", "failed", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n"))
    return both.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def _sets() -> list[tuple[int, int, int]]:
    """(filter bit, set of earlier filters, orders in which exactly those come earlier) of all 80 places of a filter."""
    fact = [1, 1, 2, 6, 24]
    return [(f, s, fact[bin(s).count("1")] * fact[4 - bin(s).count("1")]) for f in range(5) for s in range(32) if not s >> f & 1]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    A null source is the part of the empty string.  An empty table has no
    part and gives no row.  Null and empty texts fail A only, or E as well.
    """
    spark = docs.sparkSession
    n, bits = F.col("n"), F.col("failed")
    before, ways = F.col("before"), F.col("ways")
    own = F.expr("shiftleft(1, bit)")
    fails = bits.bitwiseAND(own) != 0
    fresh = bits.bitwiseAND(before) == 0
    places = F.array(*[F.struct(F.lit(f).alias("bit"), F.lit(b).alias("before"), F.lit(w).cast("long").alias("ways")) for f, b, w in _sets()])

    def total(when, value=n):
        return F.sum(F.when(when, value).otherwise(0))
    counts = stage(failures(docs, labels), "audit-counts")
    per_place = counts.select("*", F.inline(places)).groupBy("part", "bit", "before").agg(
        total(fresh & ~fails).alias("kept"), total(fresh & fails).alias("removed"), total(~fresh & fails).alias("redundant"),
        total(bits == own).alias("unique_fails"), total(fresh & fails & (F.col("good") == 1)).alias("good_lost"),
        total(fresh & fails & (F.col("toxic") == 1)).alias("toxic_lost"), total(fresh & fails, n * ways).alias("share"))
    shapley = per_place.groupBy("part", "bit").agg(F.sum("share").alias("shapley"))
    orders = []
    for order in itertools.permutations(range(5)):
        done = 0
        for step, f in enumerate(order, 1):
            orders.append(("".join(FILTERS[i] for i in order), step, f, done))
            done |= 1 << f
    orders = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, bit int, before int"))     # 600 rows
    return (per_place.join(shapley, ["part", "bit"]).join(orders, ["bit", "before"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


ORACLE = r"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM base),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text),
   regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS failed
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, failed, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT p, i AS step, p[i] AS flt, p[1:i - 1] AS before FROM o, x),
m AS (SELECT c.*, s.*, failed[flt] AS fails, len(list_filter(before, lambda b: failed[b])) > 0 AS gone FROM c, s),
r AS (SELECT part, p, step, flt, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails AND len(list_filter(failed, lambda b: b)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND fails AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN NOT gone AND fails AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM m GROUP BY part, p, step, flt)
SELECT part, array_to_string(list_transform(p, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INTEGER AS step, kept, removed,
  redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, flt))::BIGINT AS shapley FROM r
"""
