"""Language ID: interpolated Kneser-Ney character models per language, in sorted hash arrays.

Training reads labelled documents outside the held-out fold, bounded to about
``CHARS_PER_LANG`` characters a language (chosen by text hash, long texts by
passages), one text of each language at least, and counts character 4-grams in
Spark.  The models of all languages share sorted arrays
of n-gram hashes with one column of probabilities per language: the highest
order from counts, lower ones from continuation counts, each interpolated with
the next lower by its absolute discount.  A document gets the language of the
lowest cross-entropy per character.  It is rejected when that cross-entropy
lies beyond a limit calibrated on sampled documents that the models have not
seen (cross-validated where a language has few), or when it has no letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import arrow_job, fold, free, text_or_empty
from churnwise.llm.textkit import SortedHash, mix, runs

ORDER = 4
#: One fold of so many is held out.
FOLDS = 3
#: Bound of the training sample: expected characters per language.
CHARS_PER_LANG = 4_000_000
#: One sampled document of so many calibrates the rejection and trains no model.
CALIBRATE_ONE_IN = 5
#: Characters of a passage, where a language is sampled and a text is longer.
PASSAGE = 2000
#: Calibration documents that a limit needs; with fewer it is cross-validated over as many folds, in pieces of so many symbols at most.
FEW, PIECE = 5, 200
#: The limit is this quantile of the calibration documents' standardised cross-entropy, times the margin.
QUANTILE, MARGIN, LEAST_LIMIT = 0.999, 2.0, 8.0
#: Characters at which the spread of a short text's cross-entropy has doubled its variance.
SHORT = 400
#: Characters of the documents whose symbols are looked up together.
TOGETHER = 1 << 16
#: Characters that the confidence score counts at most.
SCORE_CHARS = 25
UND = "und"

U = np.uint64
_LETTER: list = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with other than letters as single spaces, and each symbol's document.

    Every document starts with ``ORDER - 1`` spaces that are context only.
    """
    lead = " " * (ORDER - 1)
    parts = [lead + (t or "").lower() + " " for t in texts]
    cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    doc = np.repeat(np.arange(len(parts)), lens)
    begin = np.cumsum(lens) - lens
    letter = _letters()[cp]
    cp = np.where(letter, cp, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]                                 # one space after each run of letters
    for k in range(ORDER - 1):
        keep[begin + k] = True
    return cp[keep].astype(U), doc[keep]


def grams(cp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions with a full context in their document, as (hi, lo): two symbols packed in each."""
    if len(cp) < ORDER:
        return np.zeros(0, np.int64), np.zeros((2, 0), U)
    at = np.flatnonzero(doc[ORDER - 1:] == doc[: len(doc) - ORDER + 1]) + ORDER - 1
    pair = (cp[:-1] << U(21)) | cp[1:]
    return at, np.stack([pair[at - 3], pair[at - 1]])


def _key(hi: np.ndarray, lo: np.ndarray, n: int) -> np.ndarray:
    """Hash of the last ``n`` symbols of packed 4-grams."""
    low = U((1 << 21) - 1)
    if n == 1:
        hi, lo = np.zeros_like(hi), lo & low
    elif n == 2:
        hi = np.zeros_like(hi)
    elif n == 3:
        hi = hi & low
    return mix(mix(hi + U(n)) + lo)


def _context(hi: np.ndarray, lo: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n - 1`` symbols before the last one, for order ``n``."""
    return _key(hi >> U(21), ((hi & U((1 << 21) - 1)) << U(21)) | (lo >> U(21)), n - 1) if n > 1 else np.zeros_like(hi)


class Models:
    """All languages' models: per order, sorted hashes with probabilities and context weights by language."""

    def __init__(self, langs: list[str], rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], floor: float | None = None):
        """rows: per language the distinct 4-grams (hi, lo) and their counts; floor: of models over more languages."""
        self.langs = langs
        vocabulary = 1 + len(np.unique(np.concatenate([lo & U((1 << 21) - 1) for _, lo, _ in rows] or [np.zeros(0, U)])))
        self.floor = floor or 1.0 / vocabulary
        self.grams: list = [None] * (ORDER + 1)
        self.weights: list = [None] * (ORDER + 1)
        level = [self._orders(*r) for r in rows]
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([lv[n]["hash"] for lv in level] or [np.zeros(0, U)]))
            contexts = np.unique(np.concatenate([lv[n]["context"] for lv in level] or [np.zeros(0, U)]))
            index = SortedHash(contexts)
            weight = np.ones((len(contexts), len(langs)))
            for j, lv in enumerate(level):
                weight[index.find(lv[n]["context"]), j] = lv[n]["gamma"]
            self.weights[n] = (index, weight)
            # a representative 4-gram of each key, for its lower orders
            all_hash = np.concatenate([lv[n]["hash"] for lv in level] or [np.zeros(0, U)])
            hi = np.concatenate([lv[n]["hi"] for lv in level] or [np.zeros(0, U)])
            lo = np.concatenate([lv[n]["lo"] for lv in level] or [np.zeros(0, U)])
            _, rep = np.unique(all_hash, return_index=True)
            found = SortedHash(keys)
            p = self._lower(hi[rep], lo[rep], n) * self._weight(hi[rep], lo[rep], n)
            for j, lv in enumerate(level):
                p[found.find(lv[n]["hash"]), j] += lv[n]["alpha"]
            self.grams[n] = (found, p)
        self.limit: dict[str, tuple[float, float, float]] = {}

    @staticmethod
    def _orders(hi, lo, count) -> list:
        """Per order n: hashes with their discounted share alpha, contexts with the interpolation weight gamma."""
        out: list = [None] * (ORDER + 1)
        for n in range(ORDER, 0, -1):
            key, ctx = _key(hi, lo, n), _context(hi, lo, n)
            few, two = np.sum(count == 1), np.sum(count == 2)
            d = few / (few + 2 * two) if few and two else 0.5
            c, inv = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(inv, count, len(c)), np.bincount(inv, minlength=len(c))
            out[n] = {"hash": key, "hi": hi, "lo": lo, "context": c, "gamma": d * kinds / np.maximum(total, 1),
                      "alpha": np.maximum(count - d, 0) / total[inv] if len(c) else count}
            # the next lower order counts distinct left neighbours
            short = _key(hi, lo, n - 1) if n > 1 else key
            _, rep, inv = np.unique(short, return_index=True, return_inverse=True)
            hi, lo, count = hi[rep], lo[rep], np.bincount(inv, minlength=len(rep)).astype(float)
        return out

    def _weight(self, hi, lo, n) -> np.ndarray:
        index, weight = self.weights[n]
        at = index.find(_context(hi, lo, n))
        return np.where((at >= 0)[:, None], weight[at], 1.0) if len(weight) else np.ones((len(hi), len(self.langs)))

    def _lower(self, hi, lo, n) -> np.ndarray:
        """Probabilities of the last symbols under order n - 1."""
        if n == 1:
            return np.full((len(hi), len(self.langs)), self.floor)
        return self.probability(hi, lo, n - 1)

    def probability(self, hi, lo, n=ORDER) -> np.ndarray:
        found, p = self.grams[n]
        at = found.find(_key(hi, lo, n))
        out = p[at] if len(p) else np.zeros((len(hi), len(self.langs)))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[miss] = self._lower(hi[miss], lo[miss], n) * self._weight(hi[miss], lo[miss], n)
        return out

    def cross_entropy(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages nats per symbol, number of symbols; 0 symbols: no letter)."""
        ce, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        # some documents at a time: the arrays of all symbols of a batch are many times its size
        group = np.cumsum([len(t or "") for t in texts]) // TOGETHER
        first = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(first, [*first[1:], len(texts)]):
            ce[lo:hi], n[lo:hi] = self._cross_entropy(texts[lo:hi])
        return ce / np.maximum(n, 1)[:, None], n

    def _cross_entropy(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages nats, number of symbols)."""
        cp, doc = symbols(texts)
        at, (hi, lo) = grams(cp, doc)
        d = doc[at]
        ce = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(at), 1 << 18):
            log = -np.log(self.probability(hi[a: a + (1 << 18)], lo[a: a + (1 << 18)]))
            for j in range(len(self.langs)):
                ce[:, j] += np.bincount(d[a: a + (1 << 18)], log[:, j], len(texts))
        return ce, np.bincount(d, minlength=len(texts))

    def calibrate(self, lang: np.ndarray, own: np.ndarray, n: np.ndarray, crossed: dict | None = None) -> None:
        """lang, cross-entropy under it and length of the calibration documents; limits of languages with few of them."""
        crossed = crossed or {}
        for j, name in enumerate(self.langs):
            x, k = own[lang == j], n[lang == j]
            if len(x) >= FEW:
                self.limit[name] = limit_of(x, k)
            elif name in crossed:
                self.limit[name] = crossed[name]
        # texts too short to be cut: the widest limits of the others
        widest = tuple(np.max(list(self.limit.values()), axis=0).tolist()) if self.limit else (-np.log(self.floor), 0.02, LEAST_LIMIT)
        for name in self.langs:
            self.limit.setdefault(name, widest)

    def predict(self, texts: list) -> dict:
        ce, n = self.cross_entropy(texts)
        if not self.langs or not len(texts):
            return {"lang": [UND] * len(texts), "score": np.zeros(len(texts)), "rejected": np.ones(len(texts), bool),
                    "entropy": np.zeros(len(texts))}
        best = np.argmin(ce, axis=1)
        own = ce[np.arange(len(texts)), best]
        p = np.exp(-(ce - own[:, None]) * np.minimum(n, SCORE_CHARS)[:, None])
        score = np.where(n > 0, 1 / p.sum(axis=1), 0.0)
        lim = np.array([self.limit[name] for name in self.langs])[best]
        rejected = (n == 0) | ((own - lim[:, 0]) / np.sqrt(1 + SHORT / np.maximum(n, 1)) > lim[:, 1] * lim[:, 2])
        lang = [self.langs[b] if k else UND for b, k in zip(best, n)]
        return {"lang": lang, "score": score, "rejected": rejected, "entropy": own}


def limit_of(x: np.ndarray, k: np.ndarray) -> tuple[float, float, float]:
    """(mean, spread, limit) of unseen documents' cross-entropies x with lengths k."""
    mean = float(np.average(x, weights=np.sqrt(k)))
    z = (x - mean) / np.sqrt(1 + SHORT / k)
    spread = max(float(np.std(z)), 0.02)
    return mean, spread, max(LEAST_LIMIT, float(np.quantile(z / spread, QUANTILE)) * MARGIN)


def crossed_limit(texts: list, floor: float) -> tuple[float, float, float] | None:
    """The limit of a language by cross-validation over pieces of its distinct texts; None for under ``FEW`` symbols."""
    pieces = []
    for t in sorted(set(texts)):
        cp, _ = symbols([t])
        pieces.append(cp[ORDER - 1:])
    size = min(PIECE, sum(map(len, pieces)) // FEW)
    if not size:
        return None
    pieces = ["".join(map(chr, p[a: a + size].tolist())) for p in pieces for a in range(0, len(p), size)]
    fold_of = np.arange(len(pieces)) % FEW
    x, k = [], []
    for f in range(FEW):
        cp, doc = symbols([p for p, g in zip(pieces, fold_of) if g != f])
        _, (hi, lo) = grams(cp, doc)
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        first = runs(hi, lo)
        if not len(first):
            continue
        model = Models([""], [(hi[first], lo[first], np.diff(first, append=len(hi)).astype(float))], floor)
        ce, n = model.cross_entropy([p for p, g in zip(pieces, fold_of) if g == f])
        x.append(ce[n > 0, 0])
        k.append(n[n > 0])
    x, k = np.concatenate(x or [np.zeros(0)]), np.concatenate(k or [np.zeros(0)])
    return limit_of(x, k) if len(x) >= 2 else None


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    cp, doc = symbols(batch.column(0).to_pylist())
    at, (hi, lo) = grams(cp, doc)
    lang = np.array(batch.column(1).to_pylist(), dtype=object)
    names, code = np.unique(lang.astype(str), return_inverse=True)
    code = code[doc[at]]
    order = np.lexsort((lo, hi, code))
    hi, lo, code = hi[order], lo[order], code[order]
    first = runs(code, hi, lo)
    return pa.RecordBatch.from_arrays(
        [pa.array(names[code[first]].tolist(), pa.string()), pa.array(hi[first].astype(np.int64)),
         pa.array(lo[first].astype(np.int64)), pa.array(np.diff(first, append=len(hi)), pa.int64())],
        names=["lang", "hi", "lo", "n"])


def _picked(docs: DataFrame, chars: int, folds: int) -> DataFrame:
    """Labelled rows outside the held-out fold that the sample takes, or may take passages of, as :func:`_sampled` reads them."""
    rows = (docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
            .filter(F.col("lang").isNotNull() & F.coalesce(fold("doc_id", folds) != 1, F.lit(False))))
    h, whole = F.xxhash64("text"), 1 << 20
    first, aside = F.pmod(h, F.lit(whole)), F.pmod(F.xxhash64("text", F.lit(7)), F.lit(CALIBRATE_ONE_IN)) == 0
    # the text that teaches a language in any case: the first one of the sample that does not calibrate, if there is one
    size = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"),
                                    F.min(F.struct((~F.col("text").rlike(r"\p{L}")).alias("blank"), aside.alias("aside"), first.alias("first"), h.alias("h"))).alias("least"))
    cut = F.least(F.lit(1.0), F.lit(float(chars)) / F.greatest("chars", F.lit(1))) * whole
    picked = (rows.join(F.broadcast(size), "lang")          # one row per language
              .select("text", "lang", h.alias("h"), first.alias("first"), cut.alias("cut"), aside.alias("aside"), (h == F.col("least.h")).alias("teaches")))
    long = (F.col("cut") < whole) & (F.length("text") > PASSAGE)
    return (picked.withColumn("long", long).filter(F.col("long") | F.col("teaches") | (F.col("first") < F.col("cut")))
            .select("text", "lang", "h", "cut", "aside", "teaches", "long"))


def training_sample(docs: DataFrame, chars: int = CHARS_PER_LANG, folds: int = FOLDS) -> DataFrame:
    """(text, lang, calibrates): labelled rows outside the held-out fold, about ``chars`` characters a language."""
    return _picked(docs, chars, folds).mapInArrow(arrow_job(_sampled), "text string, lang string, calibrates boolean")


def _sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Short texts whole and the sampled passages of long ones; a text that teaches its language gives one passage at least for training."""
    out: list = []
    for r in batch.to_pylist():
        text = r["text"]
        if not r["long"]:
            out.append((text, r["lang"], r["aside"] and not r["teaches"]))
            continue
        key = mix(np.arange(-(-len(text) // PASSAGE), dtype=U) + U(r["h"] % (1 << 64)))
        aside = mix(key) % U(CALIBRATE_ONE_IN) == 0
        take = key % U(1 << 20) < r["cut"]
        if r["teaches"] and not (take & ~aside).any():
            lettered = [i for i in np.argsort(key).tolist() if any(c.isalpha() for c in text[i * PASSAGE: (i + 1) * PASSAGE])][:1]
            take[lettered], aside[lettered] = True, False
        out += [(text[i * PASSAGE: (i + 1) * PASSAGE], r["lang"], bool(aside[i])) for i in np.flatnonzero(take).tolist()]
    text, lang, calibrates = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(lang, pa.string()), pa.array(calibrates, pa.bool_())],
                                      names=["text", "lang", "calibrates"])


def _of_sample(fn, calibrates: bool):
    """``fn`` over the sampled texts that calibrate or not, in the task and the worker that sample them."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _sampled(batch)
        found = found.filter(found.column(2) if calibrates else pc.invert(found.column(2)))
        return fn(found) if found.num_rows else None
    return arrow_job(run)


def train(docs: DataFrame, chars: int = CHARS_PER_LANG) -> Models:
    """Models of every language with labelled text, with calibrated limits; bounded by the sample, so driver-sized."""
    sample = _picked(docs, chars, FOLDS)
    counts = (sample.mapInArrow(_of_sample(_count, False), "lang string, hi long, lo long, n long")
              .groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")).toPandas())
    counts = counts.sort_values(["lang", "hi", "lo"])
    langs = sorted(counts["lang"].unique())
    models = Models(langs, [(g["hi"].to_numpy(U), g["lo"].to_numpy(U), g["n"].to_numpy(float))
                            for _, g in counts.groupby("lang")])
    if not langs:
        return models
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def entropies(batch: pa.RecordBatch) -> pa.RecordBatch:
        ce, n = shared.value.cross_entropy(batch.column(0).to_pylist())
        at = np.array([langs.index(x) if x in langs else -1 for x in batch.column(1).to_pylist()])
        ok = (n > 0) & (at >= 0)
        return pa.RecordBatch.from_arrays([pa.array(at[ok], pa.int32()), pa.array(ce[np.arange(len(at)), at][ok]), pa.array(n[ok], pa.int64())],
                                          names=["lang", "own", "n"])
    seen = (sample.mapInArrow(_of_sample(entropies, True), "lang int, own double, n long").toPandas().sort_values(["lang", "own", "n"]))
    few = [x for j, x in enumerate(langs) if np.sum(seen["lang"] == j) < FEW]
    floor, crossed = models.floor, {}
    if few:
        def cross(table: pa.Table) -> pa.Table:
            found = crossed_limit(table.column("text").to_pylist(), floor)
            rows = [(table.column("lang")[0].as_py(), *found)] if found else []
            return pa.table({x: pa.array([r[i] for r in rows], pa.float64() if i else pa.string()) for i, x in enumerate(("lang", "mean", "spread", "edge"))})
        tables = (training_sample(docs, chars).filter(F.col("lang").isin(few)).select("text", "lang").distinct().groupBy("lang")
                  .applyInArrow(cross, "lang string, mean double, spread double, edge double").collect())   # a row per language
        crossed = {r.lang: (r["mean"], r.spread, r.edge) for r in tables}
    models.calibrate(seen["lang"].to_numpy(), seen["own"].to_numpy(float), seen["n"].to_numpy(float), crossed)
    return models


def score_documents(docs: DataFrame, models: Models) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three columns appended, and their names: language, score, rejected.  Only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = docs.columns
    added = [free(x, names) for x in ("found_lang", "found_score", "found_rejected")]
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = shared.value.predict(batch.column(at).to_pylist())
        more = [pa.array(out["lang"], pa.string()), pa.array(out["score"], pa.float64()), pa.array(out["rejected"], pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *added])
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, k) for x, k in zip(added, kinds))])
    return docs.mapInArrow(arrow_job(run), schema), *added


def accepted(docs: DataFrame, chars: int = CHARS_PER_LANG) -> DataFrame:
    """The rows of ``docs`` whose language is identified; a null lang becomes the identified one."""
    scored, lang, _, rejected = score_documents(docs, train(docs, chars))
    return (scored.filter(~F.col(rejected)).withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.col(lang)))
            .select(*docs.columns))


def identify(docs: DataFrame, chars: int = CHARS_PER_LANG) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    Null texts and texts without a letter (digits, marks, empty) get ``und``,
    score 0 and are rejected.  Ties go to the language first by code point.
    Null languages teach nothing; rows with a null id are not trained on and
    not held out.  Repeated rows get equal results; an empty table gives an
    empty result, and without any labelled row all documents are ``und``.
    Columns other than doc_id, text and lang are not read.
    """
    models = train(docs, chars)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                    F.coalesce(fold("doc_id", FOLDS) == 1, F.lit(False)).alias("held_out"))
    scored, lang, score, rejected = score_documents(d, models)
    return scored.select("doc_id", "held_out", F.col(lang).alias("lang_pred"), F.col(score).alias("score"), F.col(rejected).alias("rejected"))
