import re
from collections import defaultdict

import numpy as np
import pytest

from churnwise.llm import mixing as M
from churnwise.llm.common import read

SF = "/root/testdata/sf0.01"


def test_targets_share_all_sizes_and_reshare_the_excess():
    t = M.share_targets([100, 1, 0, 50], [1, 2, 3, 1])
    assert sum(t) == pytest.approx(151) and t[1] == 3 and t[2] == 0
    assert t[0] == pytest.approx(74) and t[3] == pytest.approx(74)
    assert M.share_targets([], []) == []
    assert sum(M.share_targets([5, 1000], [3, 1])) == pytest.approx(1005)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    p = M.permuted(np.arange(n), n, 12345)
    assert sorted(p.tolist()) == list(range(n))


def test_contract_on_documents(spark):
    docs = read(spark, SF, "documents")
    first = {r.doc_id: r for r in M.mix_sources(docs).collect()}
    again = {r.doc_id: r for r in M.mix_sources(docs.repartition(5)).collect()}
    assert first == again
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in docs.select("doc_id", "text", "source").collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        got = first[r.doc_id]
        assert got["size"] == n and got.taken <= 3 * n
        size[r.source] += n
        taken[r.source] += got.taken
        target[r.source] = got.target
    want = M.share_targets([size[s] for s in sorted(size)], [M.WEIGHTS[i % 3] for i in range(len(size))])
    for s, w in zip(sorted(size), want):
        assert target[s] == pytest.approx(w) and taken[s] == pytest.approx(w, rel=0.02)
        assert all(first[d].source_size == size[s] for d in first if first[d].source == s)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = M.mix_sources(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    assert all(r["size"] == 0 and r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert sum(r.target for r in {r.source: r for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert M.mix_sources(no_docs).count() == 0


def test_mixed_documents_hold_the_words_taken(odd_docs, no_docs):
    taken, words = defaultdict(int), defaultdict(int)
    for r in M.mix_sources(odd_docs).collect():
        taken[r.doc_id, r.source] += r.taken
    mixed = M.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    for r in mixed.collect():
        words[r.doc_id, r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)
    assert M.mixed_documents(no_docs).count() == 0
