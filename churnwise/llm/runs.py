"""Periodic run detection in word sequences, by internal pattern matching.

A run is a maximal stretch of consecutive words with smallest period q that is
at least ``MIN_EXPONENT`` periods and ``MIN_LENGTH`` words long.  Whole texts
are handled in Arrow pieces, all documents of a piece at once:

1. Prefix doubling ranks the suffixes of every document (a document never
   mixes with another); the ranks of 2^k words are kept for each k, and
   suffixes that are unique already are not sorted again.
2. A wavelet matrix over the suffix array answers "which occurrence of this
   factor comes next after position x" for arrays of questions.
3. For every k, the document's aligned blocks of L = 2^k words look for their
   occurrences at distances L .. 2L - 1.  A run of period q in that range
   holds an aligned block near its start together with the copy q words on, so
   q is among the distances.  One or two occurrences are tried as they are;
   three or more form a progression with the block's own period, and there
   the one distance that maps the end of the first periodic stretch on the
   end of the other is the only candidate.
4. Candidates are extended to both sides by the kept ranks, checked for
   length, and of equal stretches the smallest period stays.

All blocks of a document are about twice its words, each asked a constant
number of questions of logarithmic time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import NOT_WS, WS, slices, text_or_empty
from churnwise.llm.sharding import CRC_TABLE
from churnwise.llm.textkit import runs as starts_of
from churnwise.llm.textkit import split_words

#: A run has at least so many periods, and so many words.
MIN_EXPONENT, MIN_LENGTH = 4, 6


def sorted_by(key: np.ndarray) -> np.ndarray:
    """Indices that sort non-negative ``key``, ties by index; packed with the index where both fit 62 bits."""
    n = len(key)
    if not n or int(key.max()) < (1 << 62) // n:
        return np.sort(key * n + np.arange(n)) % n if n else np.zeros(0, np.int64)
    return np.argsort(key, kind="stable")


class Suffixes:
    """Suffix order of the documents ``first[d] .. first[d + 1] - 1`` of ``codes``, with the ranks of 2^k words for each k.

    ``order``: suffixes sorted by (document, words); ``ranks[k][i]``: place of the first suffix that shares the
    first 2^k words of suffix i; ``blocks[k]``: (position, lo, hi) of aligned blocks of 2^k words that occur again,
    with their interval of the order.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        n, size = len(codes), np.diff(first)
        self.start = np.repeat(first[:-1], size)
        self.end = np.repeat(first[1:], size)
        doc = np.repeat(np.arange(len(size)), size)
        key = doc * (int(codes.max()) + 1 if n else 1) + codes
        order = sorted_by(key)
        active = np.arange(n)                       # slots of the order whose suffix is not unique yet
        rank = np.full(n + 1, -1, np.int32)         # one beyond the last word: equal to none
        self.ranks: list[np.ndarray] = []
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width, longest = 1, int(size.max()) if len(size) else 0
        sorted_key = key[order]
        while MIN_EXPONENT * width <= longest:
            at = starts_of(sorted_key)
            sizes = np.diff(at, append=len(active))
            place = np.repeat(active[at], sizes)
            suffix = order[active]
            rank[suffix] = place
            self.ranks.append(rank.copy() if len(active) else (self.ranks[-1] if self.ranks else rank.copy()))
            again = np.repeat(sizes > 1, sizes)
            length = np.repeat(sizes, sizes)[again]
            active, place, suffix = active[again], place[again], suffix[again]
            aligned = ((suffix - self.start[suffix]) % width == 0) & (suffix + 2 * width <= self.end[suffix])
            self.blocks.append((suffix[aligned], place[aligned], place[aligned] + length[aligned]))
            # the next level: suffixes of a class sort by the class of what follows their first half
            follow = suffix + width
            inside = follow < self.end[suffix]
            second = np.where(inside, rank[np.where(inside, follow, n)].astype(np.int64) + 1, 0)
            key = place.astype(np.int64) * (n + 1) + second
            by = sorted_by(key)
            sorted_key, order[active] = key[by], suffix[by]
            width *= 2
        self.order = order

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that agree from ``i`` and from ``j`` on, i and j in one document."""
        i, j = i.copy(), j.copy()
        begin, top = i.copy(), len(self.ranks) - 1
        todo = np.arange(len(i))
        while len(todo):
            todo = todo[self.ranks[top][i[todo]] == self.ranks[top][j[todo]]]
            i[todo] += 1 << top
            j[todo] += 1 << top
        for k in range(top - 1, -1, -1):
            same = self.ranks[k][i] == self.ranks[k][j]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that agree just before ``i`` and before ``j``, i < j."""
        i, j = i.copy(), j.copy()
        begin, top = i.copy(), len(self.ranks) - 1

        def same(k, a, b):
            back = 1 << k
            have = a >= back
            # a stretch that starts in another document is cut by its end, and cut stretches equal none
            return have & (self.ranks[k][np.where(have, a - back, len(self.order))] == self.ranks[k][np.where(have, b - back, 0)])
        todo = np.arange(len(i))
        while len(todo):
            todo = todo[same(top, i[todo], j[todo])]
            i[todo] -= 1 << top
            j[todo] -= 1 << top
        for k in range(top - 1, -1, -1):
            eq = same(k, i, j)
            i[eq] -= 1 << k
            j[eq] -= 1 << k
        return begin - i


class WaveletMatrix:
    """Counts and order statistics of values over intervals of an array, for arrays of questions at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length() if len(values) else 1)
        self.zeros: list[tuple[np.ndarray, int]] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append((before, int(before[-1])))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are below ``x``."""
        count, whole = np.zeros(len(lo), np.int64), hi - lo
        over = x >> self.bits != 0
        for level, (before, zeros) in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            l0, r0 = before[lo], before[hi]
            count += np.where(one, r0 - l0, 0)
            lo, hi = np.where(one, zeros + lo - l0, l0), np.where(one, zeros + hi - r0, r0)
        return np.where(over, whole, count)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest of values[lo:hi], from 0."""
        out, k = np.zeros(len(lo), np.int64), k.copy()
        for level, (before, zeros) in enumerate(self.zeros):
            l0, r0 = before[lo], before[hi]
            one = k >= r0 - l0
            k -= np.where(one, r0 - l0, 0)
            out |= one.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(one, zeros + lo - l0, l0), np.where(one, zeros + hi - r0, r0)
        return out


def candidates(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance): each run holds a position from which its period is among the distances."""
    if not any(len(p) for p, _, _ in s.blocks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree = WaveletMatrix(s.order - s.start[s.order])
    at, gap = [], []
    for k, (p, lo, hi) in enumerate(s.blocks):
        if not len(p):
            continue
        width, lo, hi, local = 1 << k, lo.astype(np.int64), hi.astype(np.int64), p - s.start[p]
        from_, to = tree.below(lo, hi, local + width), tree.below(lo, hi, local + 2 * width)
        some = np.flatnonzero(to > from_)
        p, lo, hi, local, from_, to = (x[some] for x in (p, lo, hi, local, from_, to))
        found = to - from_
        one = tree.smallest(lo, hi, from_)
        few = found <= 2
        at.append(p[few])
        gap.append((one - local)[few])
        more = np.flatnonzero(found >= 2)
        two = tree.smallest(lo[more], hi[more], from_[more] + 1)
        pair = found[more] == 2
        at.append(p[more[pair]])
        gap.append((two - local[more])[pair])
        many, step = more[~pair], (two - one[more])[~pair]
        here, there = p[many], p[many] - local[many] + one[many]
        distance = there + s.forward(there, there + step) - here - s.forward(here, here + step)
        fits = distance > 0
        at.append(here[fits])
        gap.append(distance[fits])
    return np.concatenate(at), np.concatenate(gap)


def find_runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; starts count over all documents of ``first``."""
    none = np.zeros(0, np.int64)
    s = Suffixes(codes, first)
    if not s.ranks:
        return none, none, none
    at, period = candidates(s)
    inside = at + period < s.end[at]
    at, period = at[inside], period[inside]
    before = s.backward(at, at + period)
    start, length = at - before, before + period + s.forward(at, at + period)
    long = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    keep = starts_of(start, length)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _piece(texts: pa.Array) -> list[pa.Array]:
    """n_words, runs, collapsed of a text column."""
    values, first = split_words(texts)
    coded = values.dictionary_encode()
    start, length, period = find_runs(coded.indices.to_numpy().astype(np.int64), first)
    doc = np.searchsorted(first, start, side="right") - 1
    per_doc = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - first[doc], length, period)], ["start", "length", "period"])
    if len(start):
        depth = np.zeros(len(values) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        keep = np.cumsum(depth[:-1]) == 0
        kept = values.filter(pa.array(keep))
        first_kept = np.concatenate([[0], np.cumsum(keep)])[first]
    else:
        kept, first_kept = values, first
    words = pa.ListArray.from_arrays(pa.array(first_kept, pa.int32()), kept)
    return [pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(per_doc), spans),
            pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())]


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row per document: the ``keep`` columns, ``n_words``, ``runs`` (start, length, period by start, then period) and
    ``collapsed``, the text without the repeated periods (kept words joined by one space).

    Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` and are compared by their
    bytes.  Null and empty texts have no words, no runs and an empty
    ``collapsed``; repeated rows are handled each; a very long text is a
    piece of its own.  An empty table gives no row.
    """
    named = {f"kept_{i}": c for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in named.items()], text_or_empty(text).alias("text"))
    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType()),
                           *[rows.schema[k] for k in named]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([*_piece(piece.column("text")), *[piece.column(k) for k in named]], schema.names)
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for k, c in named.items()], "n_words", "runs", "collapsed")


def planted_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32(doc_id) ends on 0, the words from word a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", f"{WS}+"), lambda w: w != ""))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"))
    rows = rows.withColumn("words", words).withColumn("n", F.when(n > 0, n).cast("long"))
    rows = rows.withColumn("a", g % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    moved = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get(
        F.col("words"), F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period and exponent_milli of its longest run (ties: smallest start,
    then period; null without a run), runs_sha256, collapsed_sha256.  Planted texts and odd rows: see
    :func:`planted_text` (a null id plants nothing) and :func:`periodic_runs`."""
    found = periodic_runs(planted_text(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.shorter")
    return rows.select("doc_id", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{NOT_WS}+') AS ws FROM documents),
h AS (SELECT d.*, len(ws) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM d, crc),
g AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
w AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM g),
t AS (SELECT rid, n, unnest(range(n)) AS i, unnest(ws) AS w FROM w),
m AS (SELECT x.rid, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM m),
e AS (SELECT rid, min(i) AS start, count(*) + q AS length, q FROM s GROUP BY rid, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT rid, start, length, min(q) AS period FROM e GROUP BY rid, start, length),
o AS (SELECT rid, count(*) AS n_runs, min({{'l': -length, 's': start, 'p': period}}) AS best,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
x AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT t.rid, string_agg(w, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN x ON t.rid = x.rid AND t.i = x.i GROUP BY t.rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length, best.p::BIGINT AS period,
  ((1000 * -best.l) // best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN o USING (rid) LEFT JOIN c USING (rid)
"""
