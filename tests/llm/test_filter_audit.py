import itertools
import re
from collections import Counter

import pytest

from churnwise.llm import filter_audit as A

WORDS = r"[^\x20\x09-\x0D]+"


def brute(rows, labels):
    """The audit document by document, by the definitions."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, source in rows:
        text = text or ""
        w = re.findall(WORDS, text)
        less = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                  "D": bool(re.search(r"[#$%&*|]", text)), "E": less}
        docs.append((source or "", {f for f, x in failed.items() if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = (
                    len(kept), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, f] += len(gone)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


@pytest.fixture()
def labels(spark):
    rows = [(0, 1, 0), (5, 0, 1), (5, 1, 1), (9, 1, None), (None, 1, 1), (11, None, 1), (4, 1, 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows(odd_docs, odd_rows, no_docs, labels):
    rows, df = labels
    got = A.audit(odd_docs, df)
    assert result(got) == brute([(r[0], r[1], r[3]) for r in odd_rows], rows)
    assert got.count() == 600 * len({r[3] or "" for r in odd_rows})
    assert A.audit(no_docs, df).count() == 0


def test_every_filter_and_small_shards(spark, labels, monkeypatch):
    monkeypatch.setattr(A, "SHARD_BYTES", 2000)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:200]), " ".join(words[:199]), " ".join(words[:50] * 4), " ".join(words[:100] * 2), " ".join(words[:99] * 3 + ["W"]),
             " ".join(words) + " #", "A" * 2 + "b" * 98, "A" * 3 + "b" * 97, "é w x   w", "\t\n\x0b\x0c\r a\x1cb "]
    rows = [(n, texts[n % len(texts)], f"s{n % 3}" if n % 7 else None) for n in range(60)] + [(None, texts[0], "s1"), (3, texts[3], "s0"), (3, None, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert result(A.audit(docs, labels[1])) == brute(rows, labels[0])


def test_matrix(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    """The matrix by its global ids is the documents' word counts; ids are words one to one."""
    monkeypatch.setattr(A, "SHARD_BYTES", 100)
    m = A.term_matrix(odd_docs, ["doc_id", "shard", "n_chars"])
    vocabulary = m.vocabulary.collect()
    word = {r.id: r.word for r in vocabulary}
    assert len(word) == len(set(word.values())) == len(vocabulary)
    got = []
    for s in m.shards.collect():
        assert len(s.indices) == len(s.counts) == s.indptr[-1]
        for i, doc in enumerate(s.doc_id):
            lo, hi = s.indptr[i], s.indptr[i + 1]
            got.append((doc, {word[x]: c for x, c in zip(s.indices[lo:hi], s.counts[lo:hi])}))
    want = [(r[0], dict(Counter(re.findall(WORDS, r[1] or "")))) for r in odd_rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    held = Counter(w for _, c in want for w in c)
    assert {r.word: r.documents for r in vocabulary} == held
    assert A.term_matrix(no_docs).shards.count() == 0 and A.term_matrix(no_docs).vocabulary.count() == 0
