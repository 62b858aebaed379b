import zlib
from collections import Counter

import numpy as np
import pytest

from churnwise.llm import langid as L
from churnwise.llm.common import read
from churnwise.llm.textkit import U

SF = "/root/testdata/sf0.01"


def model_of(texts):
    """Models of one text list per language, and the symbols they were counted from."""
    rows = []
    for t in texts.values():
        cp, doc = L.symbols(t)
        _, (hi, lo) = L.grams(cp, doc)
        c = Counter(zip(hi.tolist(), lo.tolist()))
        k = sorted(c)
        rows.append((np.array([a for a, _ in k], U), np.array([b for _, b in k], U), np.array([c[x] for x in k], float)))
    return L.Models(list(texts), rows)


def brute(texts, gram, vocabulary):
    """Interpolated Kneser-Ney by its definition, with dictionaries of tuples."""
    cp, doc = L.symbols(texts)
    full = Counter()
    for i in range(3, len(cp)):
        if doc[i] == doc[i - 3]:
            full[tuple(int(x) for x in cp[i - 3: i + 1])] += 1
    levels = {4: full}
    for n in (3, 2, 1):
        levels[n] = Counter(k[1:] for k in levels[n + 1])

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / vocabulary
        c = levels[n]
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = one / (one + 2 * two) if one and two else 0.5
        same = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(c[g] - d, 0) / sum(same) + d * len(same) / sum(same) * p(g[1:])
    return p(gram)


def test_probabilities_match_the_definition():
    texts = {"en": ["The cat and the hat, on the mat.", "that is the end"], "fr": ["le chat est la", "la mer et le ciel est"]}
    m = model_of(texts)
    symbols = sorted({int(x) for t in texts.values() for x in L.symbols(t)[0]})
    for probe in ("the ", " chx", "zzzz", "est "):
        cp = [ord(c) for c in probe]
        hi, lo = np.array([(cp[0] << 21) | cp[1]], U), np.array([(cp[2] << 21) | cp[3]], U)
        got = m.probability(hi, lo)[0]
        for j, t in enumerate(texts.values()):
            assert got[j] == pytest.approx(brute(t, tuple(cp), len(symbols) + 1), rel=1e-9)


def test_next_symbols_sum_to_one():
    m = model_of({"en": ["the cat and the hat on the mat"], "de": ["der hut und die katze"]})
    symbols = sorted({int(x) for t in (["the cat and the hat on the mat"], ["der hut und die katze"]) for x in L.symbols(t)[0]})
    for ctx in (" th", "xyz", "   "):
        a, b, c = (ord(x) for x in ctx)
        lo = np.array([(c << 21) | s for s in [*symbols, 0x4E2D]], U)         # and one symbol for all unseen ones
        p = m.probability(np.full(len(lo), (a << 21) | b, U), lo)
        assert np.allclose(p.sum(axis=0), 1)


def test_held_out_accuracy_and_rejection(spark):
    docs = read(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_rejects_what_is_no_language(spark):
    models = L.train(read(spark, SF, "documents"))
    out = models.predict(["Ωμέγα και άλφα βήτα γάμμα δέλτα " * 5, "the of and thing ered", "zxq vkj qqz xzk wvx " * 20, "123 !!", None])
    assert out["rejected"].tolist() == [True, False, True, True, True]
    assert out["lang"][3] == out["lang"][4] == "und" and out["score"][4] == 0


def test_odd_rows(odd_docs, odd_rows, no_docs, spark):
    rows = L.identify(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 8}
    assert not [r for r in rows if r.doc_id is None][0].held_out
    assert L.identify(no_docs).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.rejected) for r in L.identify(unlabelled).collect()] == [("und", True)]
    kept = L.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("lang is null").count() == 0


FEW_TEXTS = {"el": "Ωμέγα και άλφα βήτα γάμμα δέλτα. ", "ru": "Это один русский текст. ", "he": "זה טקסט אחד בעברית. ", "ka": "ეს არის ერთი ტექსტი. ",
             "hy": "Սա մեկ հայերեն տեքստ է. ", "th": "นี่คือข้อความเดียว ", "hi": "यह एक पाठ है। ", "ar": "هذا نص واحد فقط. ", "ko": "이것은 하나의 글이다. ", "en": "This is the one text. "}


def test_every_labelled_language_has_a_model_and_a_limit(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[2 * j + c], t * 8, name) for j, (name, t) in enumerate(FEW_TEXTS.items()) for c in (0, 1)]       # copies of one text
    models = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.langs == sorted(FEW_TEXTS)
    assert all(np.isfinite(models.limit[x]).all() for x in FEW_TEXTS)
    assert models.predict([t * 8 for t in FEW_TEXTS.values()])["lang"] == list(FEW_TEXTS)
    assert not any(models.predict([t * 8 for t in FEW_TEXTS.values()])["rejected"])
    assert models.predict(["zxq vkj qqz xzk wvx " * 50])["rejected"].tolist() == [True]


def test_long_texts_are_sampled_by_passages(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[j], t * (400_000 // len(t)), name) for j, (name, t) in enumerate(FEW_TEXTS.items())]
    sample = L.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=40_000).collect()
    for name in FEW_TEXTS:
        assert 10_000 < sum(len(r.text) for r in sample if r.lang == name) < 90_000
        assert any(r.lang == name and not r.calibrates for r in sample)


def test_memory_of_look_ups_does_not_follow_the_batch():
    import tracemalloc
    m = model_of({"en": ["The cat and the hat, on the mat."], "fr": ["le chat est la"]})
    texts = ["the cat is on the mat and the hat " * 60, None, "", "1 2", "le chat et la mer " * 40] * 150
    tracemalloc.start()
    ce, n = m.cross_entropy(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    for i in range(5):                                      # equal texts get equal values, whatever stands beside them
        alone, size = m.cross_entropy(texts[i: i + 1])
        assert (ce[i::5] == alone).all() and (n[i::5] == size).all()
