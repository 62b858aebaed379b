import hashlib
import re
import zlib

import numpy as np
import pytest

from churnwise.llm import runs as R


def brute(w):
    """All runs of a list, by comparing it with itself at every distance."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, q, length) for (s, length), q in best.items())


def found(docs):
    codes = {}
    flat = np.array([codes.setdefault(x, len(codes)) for d in docs for x in d], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    start, length, period = R.find_runs(flat, first)
    doc = np.searchsorted(first, start, side="right") - 1
    out = [[] for _ in docs]
    for d, s, n, q in zip(doc, start, length, period):
        out[d].append((int(s - first[d]), int(q), int(n)))
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    docs = [list(rng.integers(0, letters, rng.integers(0, 90))) for _ in range(400)]
    for _ in range(300):                                   # stretches of a random period, broken and nested
        block = list(rng.integers(0, letters, rng.integers(1, 40)))
        if rng.random() < 0.4:
            block = block[: 1 + len(block) // 6] * int(rng.integers(2, 7)) + list(rng.integers(0, 2, 1))
        whole = (block * int(rng.integers(1, 12)))[: int(rng.integers(1, 400))]
        docs.append(list(rng.integers(0, letters, rng.integers(0, 9))) + whole + list(rng.integers(0, letters, rng.integers(0, 9))))
    assert found(docs) == [brute(d) for d in docs]
    assert found([]) == [] and found([[], []]) == [[], []]


def test_long_runs():
    docs = [["a"] * 5000, [f"w{i % 1237}" for i in range(9000)], list("ab") * 3000 + ["c"] + list("ab") * 3000, ["a"] * 5, ["a"] * 6]
    assert found(docs) == [[(0, 1, 5000)], [(0, 1237, 9000)], [(0, 2, 6000), (6001, 2, 6000)], [], [(0, 1, 6)]]


def test_wavelet_questions():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 300, 500)
    tree = R.WaveletMatrix(v)
    lo = rng.integers(0, 499, 300)
    hi = np.array([rng.integers(a + 1, 501) for a in lo])
    x, k = rng.integers(0, 700, 300), np.array([rng.integers(0, b - a) for a, b in zip(lo, hi)])
    assert tree.below(lo, hi, x).tolist() == [int((v[a:b] < y).sum()) for a, b, y in zip(lo, hi, x)]
    assert tree.smallest(lo, hi, k).tolist() == [int(np.sort(v[a:b])[j]) for a, b, j in zip(lo, hi, k)]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found_ = brute(w)
    gone = {i for s, q, length in found_ for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, q, length in found_), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()                                 # noqa: E731
    return (doc_id, len(found_), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, q, length in found_)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_report(spark, odd_docs, odd_rows, no_docs):
    got = [tuple(r) for r in R.run_report(odd_docs).collect()]
    assert sorted((x for x in got if x[0] != 4), key=str) == sorted((expected(r[0], r[1]) for r in odd_rows if r[0] != 4), key=str)
    long = next(x for x in got if x[0] == 4)
    assert long[1:6] == (1, 0, 32000, 4, 8_000_000)
    assert R.run_report(no_docs).count() == 0
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(f"w{(i * j * 7) % 31}" for j in range(i % 150))) for i in planted + [-5, 1 << 40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [expected(*r) for r in rows]
    assert sorted(map(tuple, R.run_report(docs).collect())) == sorted(want) and sum(w[1] > 0 for w in want) > 10


def test_kept_columns(odd_docs):
    out = R.periodic_runs(odd_docs, ["doc_id", "n", "shard"])
    assert out.columns == ["doc_id", "n", "shard", "n_words", "runs", "collapsed"]
    row = out.filter("doc_id = 4").first()
    assert row["collapsed"] == "erlyating the of reinthat" and [tuple(r) for r in row["runs"]] == [(0, 32000, 4)]
