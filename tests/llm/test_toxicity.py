import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from churnwise.llm import toxicity as T
from churnwise.llm.common import read

SF = "/root/testdata/sf0.01"


def test_sentences_and_noisy_or():
    f, s, d, (data, start, end) = T.sentences(pa.array(["One two. Three!\nfour-five ...", None, "six"]))
    per_word = 1 + len(T.STEMS)
    assert len(f) == 6 * per_word and s.tolist() == [0] * (2 * per_word) + [1] * per_word + [2] * (2 * per_word) + [3] * per_word
    assert d.tolist() == [0, 0, 0, 2]
    assert [data[a:b].tobytes() for a, b in zip(start, end)] == [b"one two", b"three", b"four-five", b"six"]
    p = np.array([0.2, 0.5, 0.0, 0.9])
    with np.errstate(divide="ignore"):
        z = np.log(p / (1 - p))
    assert np.allclose(T.noisy_or(T.log_clean(z), np.array([0, 0, 1, 2]), 4), [1 - 0.8 * 0.5, 0, 0.9, 0])


def test_learns_the_sentence_from_document_labels():
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        sents = [" ".join(rng.choice(vocab, 8)) for _ in range(int(rng.integers(1, 8)))]
        bad = i % 5 == 0
        if bad:
            sents[int(rng.integers(len(sents)))] += f" scum{'' if i % 2 else 'mer'}"
        texts.append(". ".join(sents) + ".")
        labels.append(int(bad))
    f, w, b = T.fit([pa.array(texts)], np.array(labels))
    weights = np.zeros(1 << T.BITS)
    weights[f] = w
    tf, ts, td, _ = T.sentences(pa.array(["w1 w2. w3 scummy w4. w5", "w7 w8 w9. w10", ""]))
    z = b + np.bincount(ts, weights[tf], len(td))
    score = T.noisy_or(T.log_clean(z), td, 3)
    assert score[0] > 0.3 and score[1] < 0.1 and score[2] == 0
    assert z[1] == z.max()                                    # the offending sentence


def test_held_out_documents(spark):
    labels = read(spark, SF, "labels")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = T.score_documents(read(spark, SF, "documents"), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.94        # 300 labelled rows to learn from
    assert all(s.score >= 0.3 and s.text for r in rows for s in r.offending)


def test_odd_rows(odd_docs, odd_rows, no_docs, spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (4, None), (99, 1), (7, 0)], "doc_id long, toxic int")
    rows = T.score_documents(odd_docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    assert all(r.score == 0 and r.n_sentences == 0 and r.offending == [] for r in rows if r.doc_id in (1, 2, 3))
    assert T.score_documents(no_docs, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in T.score_documents(odd_docs, none).filter("doc_id <> 4").collect())


def test_sample_holds_both_labels_and_folds_copies(spark):
    assert T.shares({0: 100, 1: 4}, room=20) == {1: 1.0, 0: 0.16}
    assert T.shares({0: 100, 1: 50}, room=20) == {1: 0.2, 0: 0.1} and T.shares({}, room=20) == {}
    docs = spark.createDataFrame([(i, "same text here") for i in range(8)] + [(9, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 9)) for i in range(10)], "doc_id long, toxic int")
    rows = {r.text: (r.toxic, r.weight) for r in T.training_rows(docs, labels).collect()}
    taught = [i for i in range(10) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert rows["same text here"] == (0, float(sum(i < 8 for i in taught)))
    assert ("other" in rows) == (9 in taught)


def naive_scores(texts, weights, bias):
    """Document scores sentence by sentence, words split by a pattern, with the product itself."""
    out, known = [], {}
    for text in texts:
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            found = [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", sentence) if w]
            if not found:
                continue
            for w in found:
                known.setdefault(w, T.sentences(pa.array([w]))[0])
            clean *= 1 - 1 / (1 + math.exp(-(bias + sum(float(weights[f]) for w in found for f in known[w]))))
        out.append(1 - clean)
    return out


def test_spread_training_and_scores_by_hand(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    weights, bias = T.train(docs, labels)
    rows = sorted(T.training_rows(docs, labels).collect(), key=lambda r: r.text)
    f, w, b = T.fit([pa.array([r.text for r in rows])], np.array([r.toxic for r in rows]), np.array([r.weight for r in rows]))
    assert np.flatnonzero(weights).tolist() == f.tolist() and np.allclose(weights[f], w, atol=1e-5) and abs(b - bias) < 1e-6
    scores = {r.doc_id: r.score for r in T.score_documents(docs, labels).collect()}
    short = [r for r in docs.collect() if len(r.text or "") < 3000]
    assert len(short) > 100
    assert np.allclose([scores[r.doc_id] for r in short], naive_scores([r.text for r in short], weights, bias), atol=1e-9)


def test_gradient_against_differences():
    """The first step's gradient is that of the weighted noisy-or likelihood."""
    texts = pa.array(["a b. c d", "c a! b b", "d d d", "a. c. b c d"])
    y, weight = np.array([1.0, 0.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0, 3.0])
    f, s, d, _ = T.sentences(texts)

    def loss(w, b):
        z = b + np.bincount(s, w[f], len(d))
        p = T.noisy_or(T.log_clean(z), d, 4)
        return -(weight * np.where(y > 0, np.log(p), np.log1p(-p))).sum() / weight.sum()
    _, pull = T.start_bias(y, weight, np.bincount(d, minlength=4), rounds=0)
    on, _, g = T.pushes(texts, pull)
    for feature, got in zip(on, g / 2.0 ** 50):
        step = np.zeros(1 << T.BITS)
        step[feature] = 1e-4
        want = (loss(step, -6.0) - loss(-step, -6.0)) / 2e-4
        assert abs(got - want) < 1e-5 * max(1.0, abs(want))
