import re
from collections import Counter

import numpy as np
import pyarrow as pa

from churnwise.llm import near_dedup as N
from churnwise.llm.common import read

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id classes by comparing every pair that shares a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    at = {}
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in at.get(x, ()))
        for j, n in both.items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8 - 1e-12:
                parent[root(i)] = root(j)
        for x in s:
            at.setdefault(x, []).append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        known = [x for x in ids if x is not None]
        out.append((doc, min(known) if known else None, len(ids)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in df.collect()), key=repr)


def edited(rng, words, k):
    w = list(words)
    for i in rng.choice(len(w), k, replace=False):
        w[i] = f"new{rng.integers(10 ** 9)}"
    return " ".join(w)


def test_documents_match_brute_force(spark):
    docs = read(spark, SF, "documents").filter("doc_id % 2 = 0")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(N.near_duplicates(docs)) == brute(rows)


def test_large_groups_and_a_shared_passage(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    star = [f"s{i}" for i in range(200)]
    rows = [(i, edited(rng, star, int(rng.integers(1, 4)))) for i in range(60)]                        # one hot group
    rows += [(1000 + i, " ".join(passage + [f"o{i}x{j}" for j in range(8)])) for i in range(40)]       # alike by the passage alone
    rows += [(2000 + i, " ".join(passage + [f"u{i}x{j}" for j in range(60)])) for i in range(40)]      # below the threshold
    rows += [(3000 + i, rows[100][1]) for i in range(20)]                                              # exact copies
    assert found(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = N.near_duplicates(odd_docs)
    assert found(got) == brute(rows)
    kept = {r.doc_id for r in got.collect() if r.kept}
    assert kept == {0, 1, 2, 3, 4, 7, 8, 9, 10}
    assert N.near_duplicates(no_docs).count() == 0
    stay = N.first_of_classes(odd_docs)
    assert stay.columns == odd_docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(kept)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    n = 60
    a, b = rng.integers(1, 5, n) * 1.0, rng.integers(1, 5, n) * 1.0
    a[:10], b[10:20] = 0, 0
    b[20:30] += 0.5
    h = rng.integers(1, 1 << 62, n).astype(np.uint64)
    doc = np.repeat([0, 1], n)
    w = np.concatenate([a, b])
    on = w > 0
    sig = N.dart_signatures(np.tile(h, 2)[on], doc[on], w[on], 3, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (sig[2] == N.EMPTY).all() and not (sig[:2] == N.EMPTY).any()


def test_signature_is_the_documents_own():
    texts = ["one two three four five six", "x " * 50, "a b"]
    h, d, _ = N.distinct_shingles(pa.array(texts))
    both = N.dart_signatures(h, d, np.ones(len(h)), 3, 150)
    for i, t in enumerate(texts):
        h1, d1, _ = N.distinct_shingles(pa.array([t]))
        assert (N.dart_signatures(h1, d1, np.ones(len(h1)), 1, 150)[0] == both[i]).all()
