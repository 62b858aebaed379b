import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from churnwise.llm.common import read, stage  # noqa: E402
from churnwise.llm import sentencepiece_lattice as P  # noqa: E402
from test_near_dedup import shingles  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_and_their_decisions(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = read(spark, SF, "documents")
    rows = [docs.collect()]
    df = docs
    for name, apply in corpus_pipeline.STAGES:
        df = stage(apply(spark, df, SF), f"test-{name}")
        if name != "sentencepiece":
            assert df.columns == docs.columns
        rows.append(df.collect())
    source, lang, exact, near, mix, encoded = rows
    # language ID keeps clean documents as they are
    assert {r.doc_id for r in lang} <= {r.doc_id for r in source} and len(lang) >= 0.97 * len(source)
    # exact dedup: the smallest id of every normalised text, whole
    first = {}
    for r in lang:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(first.values())
    # near-dedup: the smallest id of every component of similar documents
    sets = {r.doc_id: shingles(r.text) for r in exact}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert sorted(r.doc_id for r in near) == [i for i in ids if root(i) == i]
    # the mix takes words of what near-dedup kept, none more than three times over
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    size = {r.doc_id: words(r.text) for r in near}
    taken = {}
    for r in mix:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + words(r.text)
    assert all(0 < n <= 3 * size[i] for i, n in taken.items())
    assert sum(taken.values()) == pytest.approx(sum(size.values()), rel=0.05)
    # every row of the mix is encoded as the library does
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    assert sorted((r.doc_id, list(r.ids)) for r in encoded) == sorted((r.doc_id, library.encode(r.text)) for r in mix)
    assert all(r.round_trip for r in encoded)


def test_run_on_odd_rows(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "n_pieces", "round_trip"] and out.count() > 0


def test_run_on_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_of_texts_are_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["bytes"])
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('four', 1000) AS text")
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    try:
        stage_of = corpus_pipeline.bounded(lambda s, d, _: d.mapInArrow(sizes, "bytes long"))
        found = [r.bytes for r in stage_of(spark, docs, SF).collect()]
    finally:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, before)
    assert sum(found) > 6000 * 4000 and max(found) < 2 * corpus_pipeline.BATCH_BYTES
