"""LM scoring by a probabilistic suffix tree over the characters of the token stream.

Symbols are the bytes of the lower-cased words (A-Z only), one separator
between words and one end symbol.  Training counts every (context of ``DEPTH``
symbols, next symbol) of all training documents; Spark sums them and derives
the shorter contexts.  A context becomes a state when it was seen ``MIN_COUNT``
times and its next-symbol distribution diverges from that of its suffix:
count * KL exceeds ``GAIN`` nats per different next symbol.  Both tests are
absolute, so the tree grows with the corpus.  Distributions are smoothed
towards the next shorter state.  Each symbol is scored in its longest suffix
state.

Contexts with the share ``MIN_SHARE`` of all training symbols are common; they
number at most ``DEPTH / MIN_SHARE`` whatever the corpus and are broadcast.  A
symbol whose whole context is common is scored at once.  Any other has a
shortest context that is not common, its root; counts and symbols meet by the
root's hash, and a task grows its roots' part of the tree onto the common one.
A root holds less than the share ``MIN_SHARE`` of the training symbols.

The ``HOT_CODES`` commonest pairs of a whole context and a symbol are scored
once, where their roots' counts meet, and their scores are broadcast; a
document asks its roots only for the others and for what training never saw.

The unigram base score needs every word's count.  The ``HOT_WORDS`` commonest
words are broadcast; the rest is a table, joined by word hash, so a word in
every document never meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.llm.common import arrow_job, fold, slices, stage
from churnwise.llm.textkit import LOWER, SortedHash, U, joined, mix, runs, words
from churnwise.session import drop_stage

DEPTH = 6
#: Times that a state was seen at least.
MIN_COUNT = 2
#: Contexts with this share of all training symbols are broadcast, the others joined.
MIN_SHARE = 1e-5
#: Distinct counts or symbols of contexts that are not common, a task of the join.
ROOT_ROWS = 1 << 19
#: Weight of the shorter state's distribution, in observations per distinct next symbol.
SMOOTH = 2.0
#: Nats that a state must gain per different next symbol (1: the Akaike criterion).
GAIN = 1.0
HOT_WORDS = 1 << 15
#: Codes whose scores are broadcast at most, 16 bytes each.
HOT_CODES = 1 << 21
#: Counts that a map task holds before it passes them on.
HELD = 1 << 21
#: FIXED VALUES: white-space bytes serve as symbols, for no word has them; 250 word bytes, separator and end.
START, SEPARATOR, END = 0x09, 0x20, 0x0A
ALPHABET = 252
#: Word hash that stands for the end token.
END_WORD = 0x0A0A0A0A0A0A0A0A


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol packed in DEPTH + 1 bytes, document) for every symbol; the symbol is the lowest byte."""
    data, off = joined(texts)
    data = LOWER[data]
    ws = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    keep = ~ws
    keep[1:] |= ws[1:] & ~ws[:-1]
    n = len(off) - 1
    keep[off[:-1][ws[off[:-1]]]] = False                       # a document's leading white space goes
    at = np.flatnonzero(keep)
    first = np.searchsorted(at, off)
    sym = np.where(ws[at], np.uint8(SEPARATOR), data[at])
    some = first[1:] > first[:-1]
    sym[first[1:][some] - 1] = END                             # the last one after the last word
    size = np.where(some, np.diff(first), 1)
    out = np.full(int(size.sum()) + n * DEPTH, START, np.uint8)
    begin = np.cumsum(size + DEPTH) - size
    doc = np.repeat(np.arange(n), size)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    full = some[doc]
    out[place[full]] = sym
    out[place[~full]] = END
    code = out[place].astype(U)
    for k in range(1, DEPTH + 1):
        code |= out[place - k].astype(U) << U(8 * k)
    return code, doc


def _merge(held: list) -> list:
    """Sum the counts of equal (kind, key) of several sorted parts."""
    kind, key, n = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((key, kind))
    kind, key, n = kind[order], key[order], n[order]
    at = runs(kind, key)
    return [(kind[at], key[at], np.add.reduceat(n, at))] if len(at) else []


def _count_task(batches):
    """Counts of words (kind 0) and codes (kind 1), combined over the task within a bound."""
    held: list = []

    def out():
        kind, key, n = held[0]
        for a in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(kind[a: a + (1 << 17)]), pa.array(key[a: a + (1 << 17)].view(np.int64)),
                                              pa.array(n[a: a + (1 << 17)])], names=["kind", "key", "n"])
    for piece in slices(batches):
        texts = piece.column(0)
        w = np.sort(words(texts, lower=True).hash)
        w = np.append(w, np.full(len(texts), U(END_WORD), U))
        c = np.sort(codes(texts)[0])
        for kind, v in ((0, w), (1, c)):
            at = runs(v)
            held.append((np.full(len(at), kind, np.int8), v[at], np.diff(at, append=len(v)).astype(np.int64)))
        if sum(len(h[1]) for h in held) > HELD:
            held = _merge(held)
            if held and len(held[0][1]) > HELD // 2:
                yield from out()
                held = []
    held = _merge(held) if held else []
    if held:
        yield from out()


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n) over all training texts, staged."""
    per_task = texts.mapInArrow(_count_task, "kind byte, key long, n long")
    return stage(per_task.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")


def _depth_sums(common=None, depth: int = DEPTH):
    """(d, key, n) of a task by depth: sums of the contexts or, of common contexts, of their codes."""
    def run(batches):
        held: list = []

        def out():
            code, n = (np.concatenate(x) for x in zip(*held))
            reach = common.value.depth(code) if common else None
            for d in range(depth + 1):
                at = slice(None) if common is None else reach >= U(d)
                key, of = np.unique(_low(code[at], d) >> U(0 if common else 8), return_inverse=True)
                m = np.bincount(of, n[at], len(key)).astype(np.int64)
                for a in range(0, len(key), 1 << 17):
                    part = slice(a, a + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), d, np.int8)), pa.array(key[part].view(np.int64)),
                                                      pa.array(m[part])], names=["d", "key", "n"])
        size = 0
        for b in batches:
            code, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            held.append((code.view(U), n))
            size += len(n)
            if size > HELD:
                yield from out()
                held.clear()
                size = 0
        if size:
            yield from out()
    return run


def contexts(counts: DataFrame, total: int, depth: int = DEPTH) -> pa.Table:
    """(d, code, n, state) of the common contexts by depth with their next symbols; code holds the context and the symbol.

    At most ALPHABET symbols follow each of at most ``depth / MIN_SHARE`` contexts, 18 bytes a row."""
    context = counts.sparkSession.sparkContext
    base = counts.filter("kind = 1").select("key", "n")

    def sums(common=None) -> DataFrame:
        return base.mapInArrow(_depth_sums(common, depth), "d byte, key long, n long").groupBy("d", "key").agg(F.sum("n").alias("n"))
    passed = sums().filter((F.col("d") == 0) | (F.col("n") >= total * MIN_SHARE)).toArrow()
    common = Common(passed.column("d").to_numpy(), passed.column("key").to_numpy() << 8)
    rows = sums(context.broadcast(common)).toArrow()
    d, code, n = (rows.column(c).to_numpy() for c in ("d", "key", "n"))
    order = np.lexsort((code, d))
    d, code, n = d[order], code[order].view(U), n[order]
    state, above, above_share = np.zeros(len(d), bool), np.zeros(0, U), np.zeros(0)
    for k in range(depth + 1):
        at = d == k
        c, m = code[at], n[at]
        _, ctx = np.unique(c >> U(8), return_inverse=True)
        all_n, kinds = np.bincount(ctx, m), np.bincount(ctx)
        share = m / all_n[ctx]
        up = above_share[np.searchsorted(above, _low(c, k - 1))] if k else share
        gain = np.bincount(ctx, m * np.log(share / up))
        state[at] = ((gain > GAIN * kinds) & (all_n >= MIN_COUNT))[ctx] if k else True
        above, above_share = c, share
    return pa.table({"d": d, "code": code.view(np.int64), "n": n, "state": state})


def _low(code: np.ndarray, d: int) -> np.ndarray:
    """The symbol and the ``d`` symbols before it."""
    return code & U((1 << (8 * (d + 1))) - 1)


def _entry(code: np.ndarray, d: int) -> np.ndarray:
    return mix(code + U(d + 1))


def _state(code: np.ndarray, d: int) -> np.ndarray:
    return mix((code >> U(8)) + U(d + 1))


class SuffixTree:
    """Sorted hashes of (state, symbol) with log10 probabilities, and of states with the weight left for shorter ones.

    ``under`` is a tree that these states are added to; they are none of its states.
    """

    def __init__(self, d: np.ndarray, code: np.ndarray, n: np.ndarray, depth: int = DEPTH, under: SuffixTree | None = None):
        self.depth = depth
        self.floor = np.log10(1.0 / ALPHABET)
        self.levels: list = []
        for k in range(depth + 1):
            self.levels.append(list(under.levels[k]) if under else [])
            c, m = code[d == k].view(U), n[d == k].astype(float)
            states, of = np.unique(_state(c, k), return_inverse=True)
            spare = SMOOTH * np.bincount(of, minlength=len(states))           # all next symbols of a state are here
            whole = np.bincount(of, m, len(states)) + spare
            p = (m + spare[of] * 10 ** self.log10(c, below=k)) / whole[of]
            key = _entry(c, k)
            order = np.argsort(key)
            self.levels[k].append((SortedHash(key[order]), np.append(np.log10(p)[order], 0.0),
                                   SortedHash(states), np.append(np.log10(spare / whole), 0.0)))

    def log10(self, code: np.ndarray, below: int | None = None) -> np.ndarray:
        """log10 probability of each code's symbol in its longest suffix state (of depth under ``below``)."""
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        for d in range((self.depth + 1 if below is None else below) - 1, -1, -1):
            for entries, log_p, states, left in self.levels[d]:
                c = _low(code[todo], d)
                at = entries.find(_entry(c, d))
                hit = at >= 0
                out[todo[hit]] += log_p[at[hit]]
                todo, c = todo[~hit], c[~hit]
                if not len(todo):
                    return out
                out[todo] += left[states.find(_state(c, d))]              # the last one, 0, where there is no such state
        out[todo] += self.floor
        return out


class Common:
    """Hashes of the common contexts by depth; a context's suffixes are as common as it is."""

    def __init__(self, d: np.ndarray, code: np.ndarray):
        self.levels = [SortedHash(np.unique(_state(code[d == k].view(U), k))) for k in range(1, DEPTH + 1)]

    def depth(self, code: np.ndarray) -> np.ndarray:
        """Depth of each code's longest common context."""
        out = np.full(len(code), DEPTH, U)
        todo = np.arange(len(code))
        for k in range(DEPTH, 0, -1):
            todo = todo[self.levels[k - 1].find(_state(_low(code[todo], k), k)) < 0]
            out[todo] = U(k - 1)
        return out


class Parents:
    """Counts of the common contexts under the full depth: what roots are compared with."""

    def __init__(self, d: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.levels = []
        for k in range(DEPTH):
            c, m = code[d == k].view(U), n[d == k].astype(float)
            key = _entry(c, k)
            order = np.argsort(key)
            ctx, of = np.unique(_state(c, k), return_inverse=True)
            self.levels.append((SortedHash(key[order]), m[order], SortedHash(ctx), np.bincount(of, m, len(ctx))))

    def share(self, code: np.ndarray, d: int) -> np.ndarray:
        """Share of each code's symbol after its common context of depth ``d``."""
        entries, n, ctx, total = self.levels[d]
        c = _low(code, d)
        return n[entries.find(_entry(c, d))] / total[ctx.find(_state(c, d))]


def rare_states(code: np.ndarray, depth: np.ndarray, n: np.ndarray, parents: Parents) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, code, n) of the states that are not common, from whole counts of their roots with the common depth of each."""
    out: list = [(np.zeros(0, np.int8), np.zeros(0, U), np.zeros(0, np.int64))]
    above, above_share = np.zeros(0, U), np.zeros(0)
    for d in range(1, DEPTH + 1):
        under = depth < d
        c, first, of = np.unique(_low(code[under], d), return_index=True, return_inverse=True)
        m = np.bincount(of, n[under], len(c)).astype(np.int64)
        _, ctx = np.unique(c >> U(8), return_inverse=True)
        total, kinds = np.bincount(ctx, m), np.bincount(ctx)
        share = m / total[ctx]
        root = depth[under][first] == d - 1
        up = np.empty(len(c))
        up[root] = parents.share(c[root], d - 1)
        up[~root] = above_share[np.searchsorted(above, _low(c[~root], d - 1))]
        kept = (np.bincount(ctx, m * np.log(share / up)) > GAIN * kinds) & (total >= MIN_COUNT)
        at = kept[ctx]
        out.append((np.full(int(at.sum()), d, np.int8), c[at], m[at]))
        above, above_share = c, share
    return tuple(np.concatenate(x) for x in zip(*out))


#: A code's free highest byte holds the depth of its longest common context where that is not the whole one.
DEPTH_BITS = 56


def _dealt(columns, tasks: int, names: list[str]):
    """Arrays of (code, ...) as one row of sorted lists per task of the codes' roots."""
    held: list = []

    def out():
        code, *more = (np.concatenate(x) for x in zip(*held))
        depth = code >> U(DEPTH_BITS)
        root = (code >> U(8)) & ((U(1) << (U(8) * (depth + U(1)))) - U(1))
        task = mix(mix(root + depth + U(1))) % U(tasks)
        order = np.lexsort((code, task))
        first = runs(task[order])
        ends = pa.array(np.append(first, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].view(np.int64))) for x in (code, *more)]
        return pa.RecordBatch.from_arrays([pa.array(task[order][first].view(np.int64)), *lists], names=["task", *names])
    size = 0
    for arrays in columns:
        if len(arrays[0]):
            held.append(arrays)
            size += len(arrays[0])
        if size > HELD // 2:
            yield out()
            held.clear()
            size = 0
    if held:
        yield out()


def _rare_counts(model, tasks: int):
    def rare(batches):
        for b in batches:
            code, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            depth = model.value[0].depth(code.view(U))
            at = depth < DEPTH
            yield code.view(U)[at] | (depth[at] << U(DEPTH_BITS)), n[at]
    return lambda batches: _dealt(rare(batches), tasks, ["code", "n"])


def pack(code: np.ndarray, times: np.ndarray) -> bytes | None:
    """Ascending codes as differences, byte plane by byte plane, and their times, compressed; None without any."""
    if not len(code):
        return None
    planes = np.diff(code, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(12, -1)
    return (np.cumsum(np.ascontiguousarray(raw[:8].T).view("<u8")[:, 0], dtype=U),
            np.ascontiguousarray(raw[8:].T).view("<u4")[:, 0].astype(np.int64))


def _rare_asked(tasks: int):
    def rare(batches):
        for b in batches:
            for row, packed in zip(b.column(0).to_pylist(), b.column(1)):
                code, times = unpack(packed.as_py())
                yield code, times, np.full(len(code), row, np.int64)
    return lambda batches: _dealt(rare(batches), tasks, ["code", "times", "row"])


def _rare_scores(model, parents):
    def run(counts: pa.Table, asked: pa.Table) -> pa.Table:
        whole = U((1 << DEPTH_BITS) - 1)
        row, code, times = (pc.list_flatten(asked.column(c)).to_numpy() for c in ("row", "code", "times"))
        c, n = (pc.list_flatten(counts.column(c)).to_numpy() for c in ("code", "n"))
        d, state, n = rare_states(c.view(U) & whole, c.view(U) >> U(DEPTH_BITS), n, parents.value)
        which, of = np.unique(code, return_inverse=True)
        log = SuffixTree(d, state, n, under=model.value[1]).log10(which.view(U) & whole)
        rows, at = np.unique(row, return_inverse=True)
        return pa.table({"row": pa.array(rows, pa.int64()), "rare": pa.array(np.bincount(at, log[of] * times, len(rows)), pa.float64())})
    return run


def _least_count(codes_n: DataFrame) -> int:
    """The least count that at most HOT_CODES codes reach, by a histogram of counts in eighths of a power of two."""
    room, least = HOT_CODES, None
    steps = codes_n.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("codes"), F.min("n").alias("n")).collect()
    for r in sorted(steps, key=lambda r: -r["step"]):         # at most 512 numbers
        if r["codes"] > room:
            break
        room, least = room - r["codes"], r["n"]
    return least if least is not None else 1 << 62


def _code_scores(model, parents, least: int):
    def run(counts: pa.Table) -> pa.Table:
        c, n = (pc.list_flatten(counts.column(x)).to_numpy() for x in ("code", "n"))
        code = c.view(U) & U((1 << DEPTH_BITS) - 1)
        d, state, m = rare_states(code, c.view(U) >> U(DEPTH_BITS), n, parents.value)
        code = code[n >= least]
        log = SuffixTree(d, state, m, under=model.value[1]).log10(code)
        return pa.table({"code": pa.array(code.view(np.int64)), "log": pa.array(log, pa.float64())})
    return run


def _score_task(model, hot, names):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        common, tree = model.value
        hot_keys, hot_n, big_n, vocab, hot_codes, hot_log = hot.value
        texts = piece.column(0)
        n = len(texts)
        code, doc = codes(texts)
        which, of = np.unique(code, return_inverse=True)
        log_p = np.zeros(len(which))
        at = hot_codes.find(mix(which))
        full = at >= 0
        log_p[full] = hot_log[at[full]]
        rest = np.flatnonzero(~full)
        depth = np.full(len(which), DEPTH, U)
        depth[rest] = common.depth(which[rest])
        whole = rest[depth[rest] == DEPTH]
        log_p[whole] = tree.log10(which[whole])
        full[whole] = True
        score = np.bincount(doc, log_p[of], n)
        left = np.flatnonzero(~full[of])                       # what neither hot codes nor common contexts decide
        left_doc, left_code = doc[left], (which | (depth << U(DEPTH_BITS)))[of[left]]
        order = np.lexsort((left_code, left_doc))
        left_doc, left_code = left_doc[order], left_code[order]
        first = runs(left_doc, left_code)
        times = np.diff(first, append=len(left_doc))
        ends = np.searchsorted(left_doc[first], np.arange(n + 1))
        rare_code = left_code[first]
        rare = [pa.array([pack(rare_code[a:b], times[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                pa.array(np.diff(ends), pa.int64())]
        w = words(texts, lower=True)
        d, at = w.doc, hot_keys.find(w.hash)
        hit = at >= 0
        log = np.log10((hot_n + 0.5) / (big_n + 0.5 * (vocab + 1)))
        base = np.bincount(d[hit], log[at[hit]], n)
        known = np.bincount(d[hit], minlength=n)
        rest_doc, rest = d[~hit], w.hash[~hit]
        cuts = np.searchsorted(rest_doc, np.arange(n + 1))
        tail = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rest.view(np.int64)))
        more = [pa.array(np.diff(w.first) + 1, pa.int64()), pa.array(score), pa.array(base), pa.array(known, pa.int64()), tail, *rare]
        return pa.RecordBatch.from_arrays([*piece.columns[1:], *more],
                                          names=[*names, "n_tokens", "score", "base_hot", "known_hot", "tail", "codes", "asked"])
    return run


def score_texts(docs: DataFrame, folds: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts hold the end token alone.  Rows with a null id are
    trained on and not held out.  Equal rows get equal scores, each its own
    row; very long texts are scored whole; an empty table gives an empty
    result.  Without any training row every count is 0 and symbols are
    uniform.  Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(fold("doc_id", folds) == 1, F.lit(False)).alias("held_out"))
    counts = corpus_counts(d.filter(~F.col("held_out")).select("text"))
    unigrams = counts.filter("kind = 0").select("key", "n")
    big_n, vocab = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    symbols = counts.filter("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = contexts(counts, symbols)                          # bounded by MIN_SHARE
    depth, code, n, state = (found.column(c).to_numpy() for c in ("d", "code", "n", "state"))
    common, tree = Common(depth, code), SuffixTree(depth[state], code[state], n[state])
    parents = spark.sparkContext.broadcast(Parents(depth, code, n))
    model = spark.sparkContext.broadcast((common, tree))
    codes_n = counts.filter("kind = 1").select("key", "n")
    distinct, least = codes_n.count(), _least_count(codes_n)
    rare_n = codes_n.mapInArrow(_rare_counts(model, 1 + distinct // ROOT_ROWS), "task long, code array<long>, n array<long>")
    scored_codes = stage(rare_n.groupBy("task").applyInArrow(_code_scores(model, parents, least), "code long, log double"), "lm-codes")
    top = scored_codes.toArrow()                               # HOT_CODES rows at most, with those of common contexts
    drop_stage(scored_codes)
    here = code[(depth == DEPTH) & (n >= least)].view(U)
    hot_code = mix(np.concatenate([top.column("code").to_numpy().view(U), here]))
    hot_log = np.concatenate([top.column("log").to_numpy(), tree.log10(here)])
    order = np.argsort(hot_code)
    hot_code, hot_log = SortedHash(hot_code[order]), hot_log[order]
    del found, depth, code, n, state, top, here, order
    end = np.uint64(END_WORD).astype(np.int64)
    hot = (unigrams.orderBy(F.desc("n"), "key").limit(HOT_WORDS).toPandas())       # HOT_WORDS rows at most
    end_n = int(unigrams.filter(F.col("key") == int(end)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    key = hot["key"].to_numpy(np.int64).view(U)
    order = np.argsort(key)
    known = spark.sparkContext.broadcast((SortedHash(key[order]), hot["n"].to_numpy(float)[order], big_n, vocab, hot_code, hot_log))
    del common, tree, hot_code, hot_log
    whole = big_n + 0.5 * (vocab + 1)
    scored = stage(d.mapInArrow(arrow_job(_score_task(model, known, ["doc_id", "held_out"])),
                                "doc_id long, held_out boolean, n_tokens long, score double, base_hot double, known_hot long, tail array<long>, "
                                "codes binary, asked long")
                   .withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tail = scored.select("row", F.explode("tail").alias("key"))
    unknown = F.log10(F.lit(0.5 / max(whole, 0.5)))
    part = (tail.join(unigrams, "key", "left").groupBy("row")
            .agg(F.sum(F.when(F.col("n").isNull(), unknown).otherwise(F.log10((F.col("n") + 0.5) / whole))).alias("base_tail"),
                 F.count("n").alias("known_tail")))
    most = max(scored.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0], distinct)
    tasks = 1 + most // ROOT_ROWS
    rare_n = codes_n.mapInArrow(_rare_counts(model, tasks), "task long, code array<long>, n array<long>")
    asked = (scored.filter("codes IS NOT NULL").select("row", "codes")
             .mapInArrow(_rare_asked(tasks), "task long, code array<long>, times array<long>, row array<long>"))
    rare = stage(rare_n.groupBy("task").cogroup(asked.groupBy("task"))
                 .applyInArrow(_rare_scores(model, parents), "row long, rare double").groupBy("row").agg(F.sum("rare").alias("rare")), "lm-rare")
    end_log = F.log10(F.lit((end_n + 0.5) / max(whole, 0.5)))
    zero = F.lit(0)
    return (scored.drop("tail", "codes", "asked").join(part, "row", "left").join(rare, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known_hot") + F.coalesce("known_tail", zero) + (1 if end_n else 0)).cast("long").alias("n_known"),
                    F.lit(int(big_n)).cast("long").alias("train_tokens"),
                    (F.col("base_hot") + F.coalesce("base_tail", F.lit(0.0)) + end_log).alias("base_score"),
                    (F.col("score") + F.coalesce("rare", F.lit(0.0))).alias("score")))
