"""Sharding: a seeded permutation of global row numbers gives every row its shard and slot.

1. Rows get global numbers in the order of (id, text digest): equal rows are
   folded to one with a count, the rest is cut into ranges by Spark's range
   partitioner, each range sums its counts, and running sums over ranges and
   within a range give each row's number.  The numbers depend on the rows
   alone, not on partitions.
2. An alternating Feistel network over a x b >= n cells (a, b about the square
   root of n) permutes the numbers; a value that lands on one of the few cells
   beyond n walks on until it is below n.  Numbers are permuted as whole
   Arrow batches; eight rounds as nested Spark expressions grow with every
   round and walk, and take the optimiser minutes.
3. Position p goes to shard ``p % shards`` and slot ``p / shards``: shard
   sizes differ by one row at most, and slots have no gaps.  ``position`` and
   ``row_at`` compute the map and its inverse for single numbers, so where a
   row went, or which row a slot holds, needs no lookup.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnwise.llm.common import free, stage, text_or_empty

SHARDS, SEED, ROUNDS = 16, 13, 8
#: Distinct rows of one numbering range on average.
RANGE_ROWS = 1_000_000
#: Equal rows that one task unfolds at once.
UNFOLD = 50_000
#: FIXED VALUE: the Mersenne prime 2^31 - 1, modulus of the round function.
PRIME = 2147483647


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    """(multiplier, addend, xor mask, second multiplier) of each round, below 2^31."""
    out = []
    for i in range(rounds):
        d = hashlib.sha256(f"feistel-{seed}-{i}".encode()).digest()
        m, a, x, s = (int.from_bytes(d[4 * j: 4 * j + 4], "little") % (PRIME - 1) for j in range(4))
        out.append((m + 1, a, x, s + 1))
    return out


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 .. n - 1 (n below 2^60)."""
    n: int
    seed: int = SEED

    @property
    def cells(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(0, self.n - 1)) + 1)
        return a, max(1, -(-self.n // a))

    def _round(self, v, key):
        m, add, x, s = key
        return ((((v % PRIME) * m + add) % PRIME) ^ x) % PRIME * s % PRIME

    def _pass(self, x):
        """The network once over an int or an int64 array."""
        a, b = self.cells
        left, right = x // b, x % b
        for i, key in enumerate(round_keys(self.seed)):
            if i % 2 == 0:
                left = (left + self._round(right, key)) % a
            else:
                right = (right + self._round(left, key)) % b
        return left * b + right

    def _back(self, y: int) -> int:
        a, b = self.cells
        left, right = y // b, y % b
        for i, key in reversed(list(enumerate(round_keys(self.seed)))):
            if i % 2 == 0:
                left = (left - self._round(right, key)) % a
            else:
                right = (right - self._round(left, key)) % b
        return left * b + right

    def position(self, row: int) -> int:
        p = self._pass(row)
        while p >= self.n:
            p = self._pass(p)
        return p

    def row_at(self, position: int) -> int:
        """The number that :meth:`position` sends to ``position``."""
        r = self._back(position)
        while r >= self.n:
            r = self._back(r)
        return r

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """:meth:`position` of an int64 array."""
        out = self._pass(rows)
        beyond = np.flatnonzero(out >= self.n)
        while len(beyond):
            out[beyond] = self._pass(out[beyond])
            beyond = beyond[out[beyond] >= self.n]
        return out


def number_rows(folded: DataFrame, order: list[str], count: str, name: str) -> tuple[DataFrame, int, int]:
    """``folded`` (one row per distinct value of ``order``, ``count`` equal rows each) with ``name`` = its first global number;
    the number of all rows, and the largest count."""
    cols = folded.columns
    at, sums = free("number_range", [*cols, name]), free("range_rows", [*cols, name])
    folded = stage(folded, "shard-rows")
    ranges = max(1, -(-folded.count() // RANGE_ROWS))
    ranged = stage(folded.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in order])
                   .withColumn(at, F.spark_partition_id()), "shard-ranges")
    most = free("most_copies", [*cols, name, sums])
    total = stage(ranged.groupBy(at).agg(F.sum(count).alias(sums), F.max(count).alias(most)), "shard-range-rows")
    # one row per million distinct rows: the running sum over ranges is a small window, its table a small broadcast
    before = total.select(at, (F.sum(sums).over(Window.orderBy(at)) - F.col(sums)).alias(sums))
    inside = Window.partitionBy(at).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = (ranged.withColumn(name, F.sum(count).over(inside) - F.col(count))
                .join(F.broadcast(before), at).withColumn(name, F.col(name) + F.col(sums)).select(*cols, name))
    n, largest = total.agg(F.sum(sums), F.max(most)).first()
    return numbered, int(n or 0), int(largest or 0)


def unfold(folded: DataFrame, first: str, count: str, largest: int) -> DataFrame:
    """One row per number ``first`` .. ``first + count - 1``; a fold of over ``UNFOLD`` rows is dealt over tasks in blocks first."""
    start = free("unfold_from", folded.columns)
    cols = [c for c in folded.columns if c not in (first, count)]
    rows = F.explode(F.sequence(F.col(start), F.least(F.col(start) + UNFOLD, F.col(first) + F.col(count)) - 1)).alias(first)
    if largest <= UNFOLD:
        return folded.withColumn(start, F.col(first)).select(*cols, rows)
    many = F.col(count) > UNFOLD
    blocks = folded.filter(many).withColumn(start, F.explode(F.sequence(F.col(first), F.col(first) + F.col(count) - 1, F.lit(UNFOLD).cast("long"))))
    few = folded.filter(~many).withColumn(start, F.col(first))
    return few.unionByName(blocks.repartition(start)).select(*cols, rows)


def slots(df: DataFrame, row: str, n: int, shards: int, seed: int) -> DataFrame:
    """``df`` with int ``shard`` and long ``slot`` of its global numbers in ``row``."""
    permutation = Permutation(n, seed)

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(permutation.positions(rows.to_numpy(np.int64)))

    place = free("place", [*df.columns, "shard", "slot"])
    return (df.withColumn(place, permuted(F.col(row)))
            .withColumns({"shard": (F.col(place) % shards).cast("int"), "slot": F.expr(f"`{place}` div {shards}L")}).drop(place))


def shard_assignment(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), row_number.

    size is the text's UTF-8 bytes plus 1 and text_crc32 its unsigned CRC-32;
    a null text counts as empty.  Numbers follow (doc_id, null first; SHA-256
    of the text).  Rows that repeat id and text take consecutive numbers and
    so land on different slots.  An empty table gives no row; other columns
    are not read.  Texts are read once and never shuffled.
    """
    t = text_or_empty()
    base = docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).alias("text_crc32"), F.sha2(t, 256).alias("digest"))
    folded = base.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count(F.lit(1)).alias("copies"))
    numbered, n, largest = number_rows(folded, ["doc_id", "digest"], "copies", "row_number")
    rows = unfold(numbered.drop("digest"), "row_number", "copies", largest)
    return slots(rows, "row_number", n, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (renamed with ``_`` where ``docs`` has them), a row per row.

    Rows equal in every column are interchangeable: one is kept with its
    count, and it is unfolded after the texts have met their numbers.
    The text crosses the shuffle once.
    """
    cols = docs.columns
    digest, copies, row = (free(c, cols) for c in ("row_digest", "row_copies", "row_number"))
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"}), 256)
    keyed = docs.withColumn(digest, whole)
    folded = keyed.groupBy("doc_id", digest).agg(F.count(F.lit(1)).alias(copies))
    numbered, n, largest = number_rows(folded, ["doc_id", digest], copies, row)
    one = keyed.dropDuplicates([digest]).join(numbered.select(digest, copies, row), digest).drop(digest)
    rows = unfold(one, row, copies, largest)
    place = {c: free(c, cols) for c in ("shard", "slot")}
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"), F.col(row).alias("number"))
    out = slots(held, "number", n, shards, seed)
    return out.select("doc.*", *[F.col(c).alias(name) for c, name in place.items()])


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, file_rows: int = 1_000_000) -> None:
    """Shard folders ``shard=K`` of Parquet files in slot order, at most ``file_rows`` rows a file; the same files on every run.

    A shard's slots are cut into ranges of ``file_rows`` that are dealt over the tasks, so a shard of any size is written by many.
    """
    out = sharded_documents(docs, shards, seed)
    shard, slot = out.columns[-2:]
    part = free("slot_range", out.columns)
    (out.withColumn(part, F.expr(f"`{slot}` div {file_rows}L")).repartition(F.col(shard), F.col(part))
     .sortWithinPartitions(shard, part, slot).drop(part).write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy(shard).parquet(folder))


def _sql_pass(x: str, a: str = "a", b: str = "b") -> tuple[str, str]:
    """SELECT items that compute the network over ``x`` step by step, and its result."""
    items, left, right = [f"{x} // {b} AS l0", f"{x} % {b} AS r0"], "l0", "r0"
    for i, (m, add, mask, s) in enumerate(round_keys(SEED)):
        other, cells = (right, a) if i % 2 == 0 else (left, b)
        name = f"{'l' if i % 2 == 0 else 'r'}{i + 1}"
        items.append(f"({left if i % 2 == 0 else right} + xor((({other} % {PRIME}) * {m} + {add}) % {PRIME}, {mask}) % {PRIME} * {s} % {PRIME}) % {cells} AS {name}")
        left, right = (name, right) if i % 2 == 0 else (left, name)
    return ", ".join(items), f"{left} * {b} + {right}"


_ITEMS, _RESULT = _sql_pass("x")
#: CRC-32 table from its rule: eight steps of the reversed polynomial for each byte.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) + 1 AS size,
  list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM d),
hashed AS (SELECT doc_id, digest, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM bytes, crc),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, digest) - 1 AS row_number FROM hashed),
side AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM hashed),
walk AS (
  SELECT row_number, 0 AS passes, row_number AS x FROM numbered
  UNION ALL
  SELECT row_number, passes + 1, place FROM (SELECT *, {_RESULT} AS place FROM (SELECT row_number, passes, n, a, b, x, {_ITEMS} FROM walk, side
    WHERE passes = 0 OR x >= n))
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard, x // {SHARDS} AS slot,
  NULL::INTEGER AS grown_shard, row_number
FROM numbered JOIN walk USING (row_number) CROSS JOIN side WHERE passes > 0 AND x < n
"""
