"""Vectorised word and n-gram hashing over the UTF-8 bytes of an Arrow text column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: FIXED VALUES: odd multiplier of the polynomial hash, its inverse modulo 2^64, the mixing constants.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

IS_WS = np.zeros(256, dtype=bool)
IS_WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 21:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(MIX[0])
    x = x ^ (x >> U(27))
    x = x * U(MIX[1])
    return x ^ (x >> U(31))


def joined(texts: pa.Array, tail: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each followed by ``tail`` (one byte), and the n + 1 offsets; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(tail, pa.large_string()))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0]: off[-1]]
    return data, off - off[0]


@dataclass
class Words:
    """Words of a batch in text order: byte spans, 64-bit hashes, and each document's range of words."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray      # document i has words first[i] .. first[i + 1] - 1
    hash: np.ndarray
    total: np.ndarray      # running sums of the polynomial hash

    def prefix(self, n: int) -> np.ndarray:
        """Hash of each word's first ``n`` bytes (of the whole word if it is shorter)."""
        stop = np.minimum(self.start + n, self.end)
        return mix((self.total[stop] - self.total[self.start]) * powers(BASE_INV, len(self.data))[self.start])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array, lower: bool = False, separators: np.ndarray = IS_WS) -> Words:
    """Words are maximal runs of bytes other than ``separators`` (white space: bytes 0x09-0x0D and 0x20)."""
    data, off = joined(texts, " " if separators[0x20] else "\n")
    if lower:
        data = LOWER[data]
    ws = separators[data]
    turn = np.flatnonzero(np.diff(ws.astype(np.int8), prepend=1))   # the joined bytes end with a separator
    start, end = turn[0::2], turn[1::2]
    first = np.searchsorted(start, off)
    if not len(start):
        return Words(data, start, end, first, np.zeros(0, U), np.zeros(1, U))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * powers(BASE_INV, len(data))[start]
    return Words(data, start, end, first, mix(h), total)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column in order, and the n + 1 offsets of each text's words; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_binary()).cast(pa.large_string()), ""))
    values = lists.flatten()
    full = pc.not_equal(values, "").to_numpy(zero_copy_only=False)       # empty strings beside leading and trailing white space
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    first = ends[np.concatenate([[0], np.cumsum(sizes)])]
    return values.filter(pa.array(full)), first


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of ``n`` words; a document of 1 to n - 1 words has its whole text as one shingle."""
    count = np.diff(w.first)
    if not len(w.hash):
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = w.hash.copy()
    for k in range(1, n):
        h[:-k] = h[:-k] * U(BASE) + w.hash[k:]
    keep = np.ones(len(h), bool)
    last = w.first[1:]
    for k in range(1, n):                       # runs that would pass the end of their document
        cut = last[count >= k] - k
        keep[cut] = False
    doc = w.doc
    out_h, out_d = mix(h[keep]), doc[keep]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        sh = np.zeros(len(short), U)
        for k in range(n - 1):
            has = count[short] > k
            sh[has] = sh[has] * U(BASE) + w.hash[w.first[short[has]] + k]
        sh = mix(sh + count[short].astype(U))
        out_h, out_d = np.concatenate([out_h, sh]), np.concatenate([out_d, short])
        order = np.argsort(out_d, kind="stable")
        out_h, out_d = out_h[order], out_d[order]
    return out_h, out_d


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal rows in jointly sorted arrays."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order with their counts."""
    v = np.sort(values)
    at = runs(v)
    return v[at], np.diff(at, append=len(v))


class SortedHash:
    """Sorted array of 64-bit hashes with a radix index on the leading bits; ``find`` is vectorised."""

    def __init__(self, keys: np.ndarray):
        """keys: ascending, distinct and well mixed."""
        self.bits = max(1, int(len(keys)).bit_length() - 1)
        edges = np.arange(1 << self.bits, dtype=U) << U(64 - self.bits)
        self.start = np.searchsorted(keys, edges).astype(np.int32)
        self.padded = np.append(keys, U(0xFFFFFFFFFFFFFFFF))

    @property
    def keys(self) -> np.ndarray:
        return self.padded[:-1]

    def find(self, q: np.ndarray) -> np.ndarray:
        """Place of each hash in ``keys``; -1 where it is absent."""
        if len(self.padded) == 1:
            return np.full(len(q), -1, np.int32)
        at = self.start[(q >> U(64 - self.bits)).astype(np.int64)]
        have = self.padded[at]
        less = np.flatnonzero(have < q)
        while len(less):
            at[less] += 1
            have[less] = self.padded[at[less]]
            less = less[have[less] < q[less]]
        at[(have != q) | (at >= len(self.padded) - 1)] = -1
        return at
