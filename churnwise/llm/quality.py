"""Quality classifier: a weak-label model feeds a hashed linear scorer.

1. Eight overlapping heuristic labellers vote good, bad or nothing on every
   document.  Spark counts the vote patterns (at most 3 ** 8 rows).
2. Expectation-maximisation over the pattern counts estimates every
   labeller's outcome rates on good documents and on the kinds of bad ones,
   and their shares; no human label is read.
3. The posterior of a document's votes is its soft label.  A linear scorer
   over hashed features (word endings, repeated neighbours, statistics in
   steps) is fitted to the posteriors of a sample bounded by ``TRAIN_DOCS``,
   in which a text weighs as many rows as a sample of rows would hold of it.
4. Every whole document gets its score; it is kept from ``CUT`` up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.llm.common import arrow_job, slices, text_or_empty
from churnwise.llm.textkit import U, mix, words

#: Expected rows of the scorer's training sample; copies of a text are one row.
TRAIN_DOCS = 12_000
#: Hashed features.
BITS = 14
CUT = 0.5
BAD, NONE, GOOD = 0, 1, 2

#: FIXED VALUES of the labellers: (name, bad from or to, good from or to); bad > good: high values are bad.
LABELLERS = (("upper_share", 0.5, 0.2), ("exclamations_per_word", 0.3, 0.05), ("symbols_per_word", 0.15, 0.05),
             ("repeated_neighbours", 0.2, 0.05), ("repeated_lines", 0.4, 0.1), ("words", 5, 20),
             ("letter_share", 0.5, 0.85), ("bytes_per_word", 1.5, 3.0))

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58)]] = 1
_KIND[[*range(97, 123), *range(128, 256)]] = 2
_KIND[[*range(65, 91)]] = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|<>{}[]\\^~_=+@"]] = True
_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True


def statistics(texts: pa.Array):
    """(documents x labellers array, words): the labellers' statistics, nan where there is nothing to judge."""
    w = words(texts)
    n = np.diff(w.first)
    # byte ranges of the documents: the joined bytes hold each text and one space
    lens = np.array([len(t.encode("utf-8")) if t else 0 for t in texts.to_pylist()]) + 1
    off = np.concatenate([[0], np.cumsum(lens)])

    def per_doc(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[off[1:]] - c[off[:-1]]).astype(float)
    kind = _KIND[w.data]
    upper, lower = per_doc(kind == 3), per_doc(kind == 2)
    letters, marks = upper + lower, per_doc((kind == 0) & ~((w.data == 0x20) | ((w.data >= 9) & (w.data <= 13))))
    digits = per_doc(kind == 1)
    same = np.zeros(len(w.hash))
    if len(w.hash) > 1:
        same[1:] = w.hash[1:] == w.hash[:-1]
        same[w.first[:-1][n > 0]] = 0
    doc = w.doc
    lines = words(texts, separators=_LINE)
    line_n = np.diff(lines.first)
    pair = np.unique(np.stack([lines.doc.astype(U), lines.hash]), axis=1) if len(lines.hash) else np.zeros((2, 0), U)
    distinct = np.bincount(pair[0].astype(np.int64), minlength=len(n))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.stack([upper / letters, per_doc(w.data == ord("!")) / n, per_doc(_SYMBOL[w.data]) / n,
                        np.bincount(doc, same, len(n)) / n, np.where(line_n >= 4, 1 - distinct / line_n, np.nan),
                        n.astype(float), letters / (letters + marks + digits), (letters + marks + digits) / n], axis=1)
    out[~np.isfinite(out)] = np.nan
    return out, w


def votes(stats: np.ndarray) -> np.ndarray:
    """BAD, NONE or GOOD for each document and labeller."""
    out = np.full(stats.shape, NONE)
    for j, (_, bad, good) in enumerate(LABELLERS):
        x = stats[:, j]
        with np.errstate(invalid="ignore"):
            out[(x > bad) if bad > good else (x < bad), j] = BAD
            out[(x <= good) if bad > good else (x >= good), j] = GOOD
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(len(LABELLERS))).sum(axis=1)


def unpattern(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


class WeakLabels:
    """Outcome rates of the labellers on good documents and on each kind of bad ones, by expectation-maximisation.

    Bad documents come in kinds that exclude each other (shouting is no
    table), so one rate for all of them would fit none: kind j holds documents
    that labeller j calls bad, and the model is a mixture of good documents
    and these kinds.
    """

    #: Share of kind j that labeller j calls bad; the largest rate of bad votes on good documents.
    OWN, FALSE_BAD = 0.98, 0.002

    def __init__(self, code: np.ndarray, count: np.ndarray, rounds: int = 200):
        v = unpattern(code)
        m = len(LABELLERS)
        bad = v == BAD
        some = bad.any(axis=1)
        # start: documents without a bad vote are mostly good, others mostly of the kinds that are voted for
        post = np.empty((len(v), m + 1))
        post[:, 0] = np.where(some, 0.2, 0.95)
        post[:, 1:] = np.where(some[:, None], 0.8 * bad / np.maximum(bad.sum(axis=1, keepdims=True), 1), 0.05 / m)
        self.share, self.rates = np.full(m + 1, 1 / (m + 1)), np.full((m + 1, m, 3), 1 / 3)
        for _ in range(rounds if len(code) else 0):
            before = post
            mass = post * count[:, None]
            self.share = (mass.sum(axis=0) + 1) / (count.sum() + m + 1)
            for k in range(3):
                self.rates[:, :, k] = mass.T @ (v == k) + 1
            self.rates /= self.rates.sum(axis=2, keepdims=True)
            self._bound()
            post = self._parts(v)
            if np.abs(post - before).max() < 1e-9:
                break

    def _bound(self) -> None:
        for j in range(len(LABELLERS)):
            for c, low, high in ((j + 1, self.OWN, 1.0), (0, 0.0, self.FALSE_BAD)):
                r = self.rates[c, j]
                want = min(max(r[BAD], low), high)
                rest = max(1 - r[BAD], 1e-12)
                r[[NONE, GOOD]] *= (1 - want) / rest
                r[BAD] = want

    def _parts(self, v: np.ndarray) -> np.ndarray:
        """Probability of good and of each bad kind given the votes."""
        j = np.arange(len(LABELLERS))
        log = np.log(self.share)[None, :] + np.log(np.maximum(self.rates[:, j, v], 1e-12)).sum(axis=2).T
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good given the votes."""
        return self._parts(v)[:, 0]

    def accuracy(self) -> np.ndarray:
        """Share of right votes among the votes cast, per labeller."""
        good, bad = self.share[0] * self.rates[0], (self.share[1:, None, None] * self.rates[1:]).sum(axis=0)
        right, wrong = good[:, GOOD] + bad[:, BAD], good[:, BAD] + bad[:, GOOD]
        return right / (right + wrong)


def features(stats: np.ndarray, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value): word starts and endings by share of words, statistics by step."""
    n = np.diff(w.first)
    doc = w.doc
    if len(doc):
        first = _KIND[w.data[w.start]].astype(U)
        last, prev = w.data[w.end - 1].astype(U), w.data[np.maximum(w.end - 2, w.start)].astype(U)
        ending = mix((first << U(16)) | (_KIND[w.data[w.end - 1]].astype(U) << U(20)) | np.where(_KIND[w.data[w.end - 1]] == 0, (prev << U(8)) | last, U(0)))
        key = doc * (1 << BITS) + (ending >> U(64 - BITS)).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        d, f = key >> BITS, key & ((1 << BITS) - 1)
        x = count / n[d]
    else:
        d, f, x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    step = np.where(np.isnan(stats), 31, np.clip(np.where(np.abs(stats) <= 1, stats * 20, 20 + np.log2(np.maximum(np.abs(stats), 1))), 0, 30)).astype(U)
    code = (mix(step + (np.arange(stats.shape[1], dtype=U) + U(1))[None, :] * U(64)) >> U(64 - BITS)).astype(np.int64)
    rows = np.repeat(np.arange(len(stats)), stats.shape[1])
    return np.concatenate([d, rows]), np.concatenate([f, code.ravel()]), np.concatenate([x, np.ones(len(rows))])


def fit(parts: list, target: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic weights over the hashed features to soft targets of weighted rows, by Adagrad."""
    rows, d, f, x = 0, [], [], []
    for a, b, c, n in parts:
        d.append(a + rows)
        f.append(b)
        x.append(c)
        rows += n
    w, g2, bias, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-4), 0.0, 1e-4
    if not rows:
        return w, bias
    d, f, x = np.concatenate(d), np.concatenate(f), np.concatenate(x)
    weight = weight / weight.sum()
    for _ in range(rounds):
        z = bias + np.bincount(d, w[f] * x, rows)
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight
        g = np.bincount(f, e[d] * x, 1 << BITS) + 1e-6 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
        gb = e.sum()
        b2 += gb * gb
        bias -= 0.3 * gb / np.sqrt(b2)
    return w, float(bias)


def training_rows(texts: DataFrame, total: int, room: int = TRAIN_DOCS) -> DataFrame:
    """text, weight of the sample: of c equal texts one row, taken with probability min(1, c * share), weight max(1, c * share).

    Hashes are counted first, so a text that holds a third of all rows crosses a shuffle as one row per task.
    """
    share = min(1.0, room / max(total, 1))
    hashed = texts.select("text", F.xxhash64("text").alias("t_hash"))
    counts = hashed.groupBy("t_hash").agg((F.count(F.lit(1)) * F.lit(share)).alias("due"))
    drawn = F.shiftrightunsigned(F.xxhash64("t_hash"), 11) / F.lit(2.0 ** 53)
    picked = counts.filter(drawn < F.col("due")).select("t_hash", F.greatest("due", F.lit(1.0)).alias("weight"))
    return (hashed.join(F.broadcast(picked), "t_hash")               # about TRAIN_DOCS rows
            .groupBy("text").agg(F.max("weight").alias("weight")))


def train(docs: DataFrame) -> tuple[WeakLabels, np.ndarray, float]:
    """Weak-label model over all documents, and the scorer fitted to a bounded sample's posteriors."""
    spark = docs.sparkSession

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        code, n = np.unique(pattern(votes(statistics(piece.column(0))[0])), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(n, pa.int64())], names=["pattern", "n"])
    d = docs.select(text_or_empty().alias("text"))
    table = (d.mapInArrow(arrow_job(count), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
             .toPandas().sort_values("pattern"))               # 3 ** 8 rows at most
    model = WeakLabels(table["pattern"].to_numpy(np.int64), table["n"].to_numpy(float))
    total = max(1, int(table["n"].sum()))
    sample = training_rows(d, total)
    shared = spark.sparkContext.broadcast(model)

    def one_task(batches):
        parts, target, weight = [], [], []
        for batch in slices(batches):
            stats, w = statistics(batch.column(0))
            parts.append((*features(stats, w), batch.num_rows))
            target.append(shared.value.posterior(votes(stats)))
            weight.append(batch.column(1).to_numpy())
        target, weight = (np.concatenate(x) if x else np.zeros(0) for x in (target, weight))
        w, b = fit(parts, target, weight)
        on = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(w[on], b))], names=["feature", "weight"])
    fitted = sample.repartition(1).sortWithinPartitions("text").mapInArrow(one_task, "feature long, weight double").toPandas()
    weights = np.zeros(1 << BITS)
    own = fitted[fitted["feature"] >= 0]
    weights[own["feature"].to_numpy(np.int64)] = own["weight"].to_numpy()
    return model, weights, float(fitted[fitted["feature"] < 0]["weight"].sum())       # no row on an empty table


def classify(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, weak_label (posterior of good), score, kept.

    Null and empty texts cast the vote of their length alone (bad).  Equal
    texts get equal results; repeated rows are rows of their own; very long
    texts are read whole; an empty table gives an empty result.  Columns
    other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        model, weights, bias = shared.value
        stats, w = statistics(piece.column(0))
        d, f, x = features(stats, w)
        z = bias + np.bincount(d, weights[f] * x, piece.num_rows)
        score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return pa.RecordBatch.from_arrays([piece.column(1), pa.array(model.posterior(votes(stats))), pa.array(score), pa.array(score >= CUT)],
                                          names=["doc_id", "weak_label", "score", "kept"])
    d = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return d.mapInArrow(arrow_job(run), "doc_id long, weak_label double, score double, kept boolean")
