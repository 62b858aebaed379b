"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability is a logistic score over its hashed words and word
stems (leading bytes, for inflected forms); the document's is their noisy-or.
Weights are fitted to document labels alone by proximal Adagrad on the
noisy-or likelihood, over a sample of labelled rows bounded by ``TRAIN_DOCS``:
as many toxic rows as clean ones where there are enough, each weighted by the
rows it stands for, copies of a text as one row.  Scoring reads every whole
text, and the same sentence scores locate the offending sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.llm.common import arrow_job, fold, stage, text_or_empty
from churnwise.llm.textkit import U, joined, mix, runs, words

#: Expected rows of the training sample.
TRAIN_DOCS = 12_000
#: Tasks that read the sample.
TASKS = 24
#: Hashed features; the weights are one number each, so their broadcast is bounded.
BITS = 20
#: Words of fewer sampled documents than this are left out.
LEAST_DOCS = 4
EPOCHS, STEP, SHRINK = 400, 0.5, 2e-4
#: Leading bytes of a word that are features too.
STEMS = (4, 6)
#: FIXED VALUE: score from which a document is predicted toxic, and a sentence is reported.
CUT = 0.3

SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = [not chr(i).isalnum() for i in range(128)]
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?\n"]] = True


def sentences(texts: pa.Array):
    """(feature, sentence) of every word and stem, the document of every sentence, and each sentence's byte span.

    Sentences end after ``. ! ?`` or a line break; words are runs of letters,
    digits and non-ASCII bytes, in lower case (A-Z).  Only sentences with a
    word count.
    """
    w = words(texts, lower=True, separators=SEPARATORS)
    kinds = [w.hash, *(w.prefix(k) * U(2 * k + 1) for k in STEMS)]
    feature = np.stack([(mix(h) >> U(64 - BITS)).astype(np.int64) for h in kinds], axis=1).ravel()
    doc = w.doc
    stop = np.cumsum(STOPS[w.data])
    number = stop[w.start] if len(w.start) else np.zeros(0, np.int64)
    first = runs(doc, number) if len(doc) else np.zeros(0, np.int64)
    sentence = np.repeat(np.arange(len(first)), np.diff(first, append=len(doc)))
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return feature, np.repeat(sentence, len(kinds)), doc[first], (w.data, w.start[first], w.end[last] if len(first) else first)


def noisy_or(log_clean: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - product over a document's sentences of (1 - p), from log(1 - p)."""
    return -np.expm1(np.bincount(doc, log_clean, n))


def log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z)) without overflow."""
    return -np.logaddexp(0.0, z)


def start_bias(y: np.ndarray, weight: np.ndarray, n_sentences: np.ndarray, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Bias of a model without words, and the pull of each document's sentences on it."""
    total, b, b2 = max(weight.sum(), 1.0), -6.0, 1e-6
    for _ in range(rounds):
        pull = _pull(n_sentences * log_clean(b), y) / (1 + np.exp(-b)) * weight / total
        gb = (pull * n_sentences).sum()
        b2 += gb * gb
        b = min(-3.0, b - STEP * gb / np.sqrt(b2))
    return float(b), _pull(n_sentences * log_clean(b), y) / (1 + np.exp(-b)) * weight / total


def _pull(clean: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient factor of a document: clean ones pull each sentence down, toxic ones push the likeliest up."""
    p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
    return np.where(y > 0, -(1 - p) / p, 1.0)


def pushes(texts: pa.Array, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, documents that hold each, gradient at the start as a whole number of 2^-50).

    Whole numbers add up the same in any order, so the features kept do not depend on the tasks.
    """
    f, s, d, _ = sentences(texts)
    docs = np.bincount(np.unique(d[s] * (1 << BITS) + f) & ((1 << BITS) - 1), minlength=1 << BITS) if len(f) else np.zeros(1 << BITS, np.int64)
    whole = np.round(pull * 2.0 ** 50).astype(np.int64)
    order = np.argsort(f, kind="stable")
    on = np.flatnonzero(docs)
    return on, docs[on], np.add.reduceat(whole[d[s[order]]], runs(f[order])) if len(f) else np.zeros(0, np.int64)


def strong(feature: np.ndarray, docs: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Features of enough documents whose gradient the penalty does not outweigh by far at the start, sorted."""
    return np.sort(feature[(docs >= LEAST_DOCS) & (np.abs(gradient) >= SHRINK / 2 * 2.0 ** 50)])


def compact(texts: pa.Array, used: np.ndarray):
    """Per text: (number of sentences without a used feature, its used features by place, their sentences from 0)."""
    f, s, d, _ = sentences(texts)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    f = place[f]
    f, s = f[f >= 0], s[f >= 0]
    n = np.bincount(d, minlength=len(texts))
    held = np.unique(s)
    plain = n - np.bincount(d[held], minlength=len(texts))
    at = np.searchsorted(d[s], np.arange(len(texts) + 1))
    number = np.searchsorted(held, s)
    for i in range(len(texts)):
        mine = number[at[i]: at[i + 1]]
        yield int(plain[i]), f[at[i]: at[i + 1]], (mine - mine[0] if len(mine) else mine).astype(np.int32)


def weigh(used: np.ndarray, y: np.ndarray, weight: np.ndarray, plain: np.ndarray, fs: list, ss: list, bias: float) -> tuple[np.ndarray, float]:
    """Weights of the used features and the bias, by proximal Adagrad on the weighted noisy-or likelihood."""
    rows, total = len(y), max(weight.sum(), 1.0)
    per = np.array([int(x[-1]) + 1 if len(x) else 0 for x in ss], np.int64)          # sentences that hold a used feature
    first = np.concatenate([[0], np.cumsum(per)])
    groups, d = int(first[-1]), np.repeat(np.arange(rows), per)
    f = np.concatenate(fs) if fs else np.zeros(0, np.int32)
    s = np.concatenate([x + first[i] for i, x in enumerate(ss)]).astype(np.int64) if ss else np.zeros(0, np.int64)
    by_sentence = runs(s)
    order = np.argsort(f, kind="stable")
    by_feature, s_of = runs(f[order]), s[order]
    seen = f[order][by_feature]
    w, g2, b, b2 = np.zeros(len(used)), np.full(len(used), 1e-6), bias, 1e-6

    def scores(b):
        z = b + (np.add.reduceat(w[f], by_sentence) if groups else np.zeros(0))
        return z, np.bincount(d, log_clean(z), rows) + plain * log_clean(b)
    for _ in range(EPOCHS if rows else 0):
        z, clean = scores(b)
        pull = _pull(clean, y) * weight / total
        at = pull[d] / (1 + np.exp(-np.clip(z, -40, 40)))
        g = np.zeros(len(used))
        if len(f):
            g[seen] = np.add.reduceat(at[s_of], by_feature)
        g2 += g * g
        rate = STEP / np.sqrt(g2)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SHRINK, 0.0)
        gb = at.sum() + (pull * plain).sum() / (1 + np.exp(-b))
        b2 += gb * gb
        b = min(-3.0, b - STEP * gb / np.sqrt(b2))
    # the bias that errs least at the fixed cut: many harmless sentences must not add up in long documents
    shifts = sorted(np.linspace(-4, 1, 26), key=abs)
    wrong = [weight[(-np.expm1(scores(b + x)[1]) >= CUT) != (y > 0)].sum() for x in shifts] if rows else [0.0]
    return w, float(b + shifts[int(np.argmin(wrong))])


def fit(texts: list[pa.Array], labels: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of the sentence model, from document labels and the documents' weights."""
    text = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
    y = np.asarray(labels, float)
    weight = np.ones(len(y)) if weight is None else weight
    bias, pull = start_bias(y, weight, np.bincount(sentences(text)[2], minlength=len(y)))
    used = strong(*pushes(text, pull))
    parts = list(compact(text, used))
    w, bias = weigh(used, y, weight, np.array([p[0] for p in parts], float), [p[1] for p in parts], [p[2] for p in parts], bias)
    on = np.flatnonzero(w)
    return used[on], w[on], bias


def shares(counts: dict[int, int], room: int = TRAIN_DOCS) -> dict[int, float]:
    """Share of each label's rows in the sample: equal numbers of both labels, what one cannot fill goes to the other."""
    out, left = {}, len(counts)
    for label, n in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        take = min(n, room // left)
        out[label], room, left = take / n, room - take, left - 1
    return out


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 4) -> DataFrame:
    """The sample: a row per text and label, ``weight`` the labelled rows it stands for.  Rows of the held-out fold, null ids and null labels teach nothing."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("l_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
           .filter("l_id IS NOT NULL AND toxic IS NOT NULL").filter(fold("l_id", folds) != 2)
           .groupBy("l_id").agg(F.max("toxic").alias("toxic")))
    part = shares({r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()})      # two rows
    share = F.when(F.col("toxic") == 1, part.get(1, 1.0)).otherwise(part.get(0, 1.0))
    drawn = F.shiftrightunsigned(F.xxhash64("l_id"), 11) / F.lit(2.0 ** 53)
    picked = lab.filter(drawn < share).select("l_id", "toxic", (1 / share).alias("weight"))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))      # about TRAIN_DOCS rows
            .groupBy("text", "toxic").agg(F.sum("weight").alias("weight")))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4) -> tuple[np.ndarray, float]:
    """Dense weights and bias.  Tasks read the sample's texts; one task moves the weights over the compact rows they return."""
    spark = docs.sparkSession
    rows = stage(training_rows(docs, labels, folds).withColumn("key", F.xxhash64("text", "toxic")), "toxic-sample")
    spread = rows.repartition(TASKS, "key")

    def count(piece):
        n = np.bincount(sentences(piece.column(0))[2], minlength=piece.num_rows)
        return pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(n, pa.int64())], names=["key", "toxic", "weight", "n"])
    have = (spread.select("text", "key", "toxic", "weight").mapInArrow(arrow_job(count), "key long, toxic int, weight double, n long")
            .toPandas().sort_values(["key", "n", "weight"]))                  # four numbers a row of the sample
    bias, pull = start_bias(have["toxic"].to_numpy(float), have["weight"].to_numpy(), have["n"].to_numpy())
    pulls = spark.sparkContext.broadcast((have["key"].to_numpy(), pull))

    def push(piece):
        key, pull = pulls.value
        f, n, g = pushes(piece.column(0), pull[np.searchsorted(key, piece.column(1).to_numpy())])
        return pa.RecordBatch.from_arrays([pa.array(f), pa.array(n), pa.array(g)], names=["feature", "docs", "gradient"])
    pushed = (spread.select("text", "key").mapInArrow(arrow_job(push), "feature long, docs long, gradient long")
              .groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("gradient").alias("gradient")).toPandas())      # 2^BITS rows at most
    used = strong(*(pushed[c].to_numpy(np.int64) for c in ("feature", "docs", "gradient")))
    wanted = spark.sparkContext.broadcast(used)

    def pack(piece):
        plain, f, s = zip(*compact(piece.column(0), wanted.value))
        return pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(plain, pa.int64()), pa.array([x.tobytes() for x in f], pa.binary()),
                                           pa.array([x.tobytes() for x in s], pa.binary())], names=["key", "toxic", "weight", "plain", "f", "s"])

    def one_task(batches):
        y, weight, plain, fs, ss = [], [], [], [], []
        for b in batches:
            y.append(b.column(1).to_numpy())
            weight.append(b.column(2).to_numpy())
            plain.append(b.column(3).to_numpy())
            fs += [np.frombuffer(x, np.int32) for x in b.column(4).to_pylist()]
            ss += [np.frombuffer(x, np.int32) for x in b.column(5).to_pylist()]
        y, weight, plain = (np.concatenate(x).astype(float) if x else np.zeros(0) for x in (y, weight, plain))
        w, b = weigh(wanted.value, y, weight, plain, fs, ss, bias)
        on = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(wanted.value[on], -1)), pa.array(np.append(w[on], b))], names=["feature", "weight"])
    fitted = (spread.select("text", "key", "toxic", "weight")
              .mapInArrow(arrow_job(pack), "key long, toxic int, weight double, plain long, f binary, s binary")
              .repartition(1).sortWithinPartitions("key", "plain").mapInArrow(one_task, "feature long, weight double").toPandas())
    for shared in (pulls, wanted):
        shared.destroy()
    weights = np.zeros(1 << BITS, np.float32)
    own = fitted[fitted["feature"] >= 0]
    weights[own["feature"].to_numpy(np.int64)] = own["weight"].to_numpy()
    last = fitted[fitted["feature"] < 0]["weight"]
    return weights, float(last.iloc[0]) if len(last) else -6.0               # nothing to learn from


OUT = "doc_id long, held_out boolean, score double, predicted int, n_sentences int, offending array<struct<sentence:int,score:double,text:string>>"


def _score(shared):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        weights, bias = shared.value
        texts = piece.column(0)
        n = len(texts)
        f, s, d, (data, start, end) = sentences(texts)
        z = bias + np.bincount(s, weights[f], len(d))
        score = noisy_or(log_clean(z), d, n)
        ps = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        first = np.searchsorted(d, np.arange(n))
        bad = np.flatnonzero(ps >= CUT)
        raw = joined(texts)[0]
        found: list = [[] for _ in range(n)]
        for i in bad.tolist():
            found[d[i]].append({"sentence": int(i - first[d[i]]), "score": float(ps[i]),
                                "text": raw[start[i]: end[i]].tobytes().decode("utf-8", "replace")})
        kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
        return pa.RecordBatch.from_arrays(
            [piece.column(1), piece.column(2), pa.array(score), pa.array((score >= CUT).astype(np.int32)),
             pa.array(np.bincount(d, minlength=n).astype(np.int32)), pa.array(found, kind)],
            names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])
    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_sentences, offending.

    Null and empty texts have no sentence and score 0.  Labels that are null,
    repeated (the highest counts), or of unknown documents are fine; without
    any label every score is near 0.  Rows with a null id are not trained on
    and not held out.  Equal texts get equal scores; very long ones are scored
    whole; an empty table gives an empty result.  Columns other than doc_id
    and text (documents), doc_id and toxic (labels) are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    d = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return d.mapInArrow(arrow_job(_score(shared)), OUT)
