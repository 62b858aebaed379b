import hashlib
import re

from churnwise.llm import exact_dedup as X
from churnwise.llm.common import read

SF = "/root/testdata/sf0.001"


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(odd_docs, odd_rows):
    assert found(X.exact_dedup(odd_docs)) == brute([(r[0], r[1]) for r in odd_rows])


def test_colliding_keys_and_small_buckets(spark, odd_docs, odd_rows):
    # four keys in all: chains hold different texts, told apart by their bytes
    assert found(X.exact_dedup(odd_docs, bucket_bytes=64, hash_bits=2)) == brute([(r[0], r[1]) for r in odd_rows])
    docs = read(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(X.exact_dedup(docs, bucket_bytes=1024, hash_bits=3)) == brute(rows)


def test_empty_table(no_docs):
    assert X.exact_dedup(no_docs).count() == 0


def test_directory_splits_until_buckets_fit():
    cells = {0: 5, 1: 5, 2: 1, 3: 1, 7: 30}
    got = X.split_directory(cells, 3, 10)
    assert len(got) == 8 and got == sorted(got)
    sums = {}
    for cell, n in cells.items():
        sums[got[cell]] = sums.get(got[cell], 0) + n
    # over the capacity only where a single entry is left
    assert all(n <= 10 or got.count(b) == 1 for b, n in sums.items())


def test_first_copies_keep_one_row_of_each_text(odd_docs, odd_rows):
    kept = X.first_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(norm) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in odd_rows})
