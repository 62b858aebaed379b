"""SentencePiece encoding and decoding by a relational lattice.

1. Texts are cut into units at places that no piece of the model spans, so
   units are encoded on their own; Spark counts the distinct ones.
2. Every unit is exploded to its substrings of at most the longest piece's
   length, which equi-join the piece table (fixed size, broadcast) on their
   64-bit hash and are then compared.  Single characters that are no piece
   become byte-fallback edges.
3. The Viterbi recursion is folded over the end positions.  For a BPE model
   tasks join and fold units of one length together, as columns; for a unigram
   model edges are grouped by unit and folded by a higher-order ``aggregate``.
4. The best path of a BPE model is the one whose merges come first: a path's
   cost is the sorted list of (rank, position) of all merges that build its
   pieces, compared from the front.  Costs of joined paths add as unions, so
   Viterbi is exact, and the result equals the library's merges.  For a
   unigram model the cost is the negative sum of log probabilities.
5. The ``HOT_UNITS`` commonest units are broadcast as sorted hash arrays and
   resolved where the documents are; the rest joins by unit hash and returns to
   its document.  The decoded ids are compared with the text, and a text that
   differs (two units of one hash) is merged unit by unit.

The model file is a parameter and is read on the driver; it is never trained.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.llm.common import arrow_job, give_back, slices, stage
from churnwise.llm.textkit import BASE, BASE_INV, SortedHash, U, mix, powers, runs
from churnwise.session import drop_stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units broadcast at most, as sorted arrays; they are no longer than LONG characters.
HOT_UNITS = 1 << 19
#: Units beyond this length are encoded where their document is: a heap of merges or the same recursion in a loop.
LONG = 96
#: Tasks that cut and fold units, in shuffle partitions of the session.
SPREAD = 12
#: Distinct units a map task holds before it passes its counts on.
HELD = 1 << 18
#: Costs of paths that a task folds at once.
FOLDED = 1 << 20
#: FIXED VALUE: seed of Spark's xxhash64.
SEED = 42
SPACE = "▁"
#: A merge is rank * 2 ** SHIFT + position in its unit.
SHIFT = 20
LAST = (1 << 63) - 1


class Pieces:
    """The piece table of a SentencePiece model file: pieces, ids, costs and the pattern that cuts units."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models with a normalisation table are not supported")
        self.bpe = m.trainer_spec.model_type == 2
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.text = [p.piece for p in m.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.normal = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == 1}
        self.special = {i for i, p in enumerate(m.pieces) if p.type == 3}
        self.longest = max(map(len, self.normal), default=1)
        self.rank = {p: round(-s) for p, (_, s) in self.normal.items()} if self.bpe else {}
        self.pattern = self._cuts()
        self._kinds()

    def merges(self, unit: str) -> tuple[list[str], list[int]]:
        """Pieces of a unit and its merges, by merging the best neighbours first (builds the table, handles LONG units)."""
        import heapq
        parts: list = list(unit)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        done: list[int] = []
        heap: list = []

        def offer(i):
            j = after[i]
            if j >= 0:
                r = self.rank.get(parts[i] + parts[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))
        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            done.append((r << SHIFT) + i)
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None], sorted(done)

    def char_ids(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8")] if self.bytes else [self.unknown]

    def long_ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for p in (self.merges(unit)[0] if self.bpe else self._cheapest(unit)):
            out += [self.normal[p][0]] if p in self.normal else self.char_ids(p)
        return out

    def _cheapest(self, unit: str) -> list[str]:
        """Pieces of a unigram model's best path: the lattice's recursion and costs over a whole unit of any length."""
        cost, came = [0.0], [0]
        for end in range(1, len(unit) + 1):
            best, at = cost[-1] + 1e6, end - 1                # a character that is no piece
            for start in range(max(0, end - self.longest), end):
                p = self.normal.get(unit[start: end])
                if p is not None and cost[start] - p[1] < best:
                    best, at = cost[start] - p[1], start
            cost.append(best)
            came.append(at)
        out, end = [], len(unit)
        while end:
            out.append(unit[came[end]: end])
            end = came[end]
        return out[::-1]

    def _cuts(self) -> re.Pattern:
        """Units: spaces and what follows; letters, digits and other marks part where no piece joins their kinds."""
        kinds = {"L": r"[^\W\d_]", "D": r"\d", "O": r"(?:[^\w%s\n]|_)" % SPACE}

        def kind(c):
            return "S" if c == SPACE else "L" if re.match(kinds["L"], c) else "D" if re.match(r"\d", c) else "N" if c == "\n" else "O"
        joined = {(kind(a), kind(b)) for p in self.normal for a, b in zip(p, p[1:])}
        if any(b == "S" and a != "S" or "N" in (a, b) for a, b in joined):
            self.coarse = None
            return re.compile("(?s).+")                       # no safe place: the text is one unit
        self.coarse = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        groups, left = [], list("LDO")
        self.bodies, self.several = [], []
        while left:                                           # kinds that some piece joins stay together
            g = [left.pop(0)]
            for k in g:
                more = [x for x in left if (k, x) in joined or (x, k) in joined]
                g += more
                left = [x for x in left if x not in more]
            body = kinds[g[0]] if len(g) == 1 else "(?:" + "|".join(kinds[k] for k in g) + ")"
            several = any((a, b) in joined for a in g for b in g)
            self.bodies.append(body)
            self.several.append(several)
            groups.append(body + ("+" if several else ""))
        heads = "|".join(groups)
        return re.compile(rf"{SPACE}*(?:{heads})|{SPACE}+|\n")

    def _kinds(self) -> None:
        """Group of each code point: 0 space mark, 1 line break, then the groups that ``pattern`` keeps together."""
        self.group = np.full(0x110000, 2, np.uint8)
        self.repeats = np.ones(3, bool)
        if self.coarse is None:
            return
        self.repeats = np.array([True, False, *self.several])
        whole = "".join(map(chr, range(0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        for i, body in enumerate(self.bodies):
            self.group[[m.start() for m in re.finditer(body, whole)]] = i + 2
        self.group[ord("\n")], self.group[ord(SPACE)] = 1, 0

    def marked(self, text: str) -> str:
        """The text as pieces spell it."""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def words(self, text: str) -> list[str]:
        """Coarse cuts of a text, at spaces and line breaks; each word's units are ``pattern.findall(word)``."""
        if not text:
            return []
        s = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.coarse is None:
            return [s]
        if SPACE * 2 in s or "\x01" in s:
            return self.coarse.findall(s)
        return [w for w in s.replace(SPACE, "\x01" + SPACE).replace("\n", "\x01\n\x01").split("\x01") if w]

    def units(self, text: str) -> list[str]:
        return [u for w in self.words(text) for u in self.pattern.findall(w)]

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, cost): cost is the piece's merges, or one number for a unigram model; at most the vocabulary's size."""
        rows = []
        for p, (i, score) in self.normal.items():
            if self.bpe:
                parts, cost = self.merges(p)
                if len(parts) == 1:                           # pieces that merging cannot reach are no edges
                    rows.append((p, i, cost))
            else:
                rows.append((p, i, [-score]))
        return spark.createDataFrame(rows, f"piece string, id int, cost array<{'long' if self.bpe else 'double'}>")

    def decode(self, ids: list[int]) -> str:
        """Text of ids: special ids vanish, byte pieces join to UTF-8, the prefix space goes."""
        back = {i: b for b, i in self.bytes.items()}
        out = b"".join(b"" if i in self.special else bytes([back[i]]) if i in back else self.text[i].encode("utf-8") for i in ids)
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Cut:
    """Units of a list of texts in order: code points, spans, and the distinct ones by a 64-bit hash."""

    def __init__(self, model: Pieces, texts: list):
        marked = [model.marked(t) if t else "" for t in texts]
        self.marked, self.whole = marked, "".join(marked)
        point = np.frombuffer(self.whole.encode("utf-32-le"), np.uint32)
        group = model.group[point]
        first = np.ones(len(point), bool)
        before, here = group[:-1], group[1:]
        first[1:] = np.where(here == before, ~model.repeats[here], (before != 0) | (here == 1))
        size = np.array([len(m) for m in marked], np.int64)
        begin = np.cumsum(size) - size
        first[begin[size > 0]] = True
        self.start = np.flatnonzero(first)
        self.end = np.append(self.start[1:], len(point))[:len(self.start)]
        self.doc = np.repeat(np.arange(len(marked)), size)[self.start]
        total = np.zeros(len(point) + 1, U)
        np.cumsum((point.astype(U) + U(1)) * powers(BASE, len(point)), out=total[1:])
        h = mix((total[self.end] - total[self.start]) * powers(BASE_INV, len(point))[self.start]) if len(point) else np.zeros(0, U)
        order = np.argsort(h)
        self.one = runs(h[order])                             # first places of the distinct units in ``order``
        self.n = np.diff(self.one, append=len(h))
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.repeat(np.arange(len(self.one)), self.n)
        self.one = order[self.one]
        self.length = (self.end - self.start)[self.one]

    def text(self, which: np.ndarray) -> list[str]:
        at = self.one[which]
        return [self.whole[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())]


def _unit_task(pieces):
    """(unit, n): units of a task, combined within a bound."""
    def run(batches):
        held: dict = {}

        def out():
            keys = list(held)
            for a in range(0, len(keys), 1 << 16):
                part = keys[a: a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[k] for k in part], pa.int64())], names=["unit", "n"])
            held.clear()
        model = pieces.value
        for piece in slices(batches):
            cut = Cut(model, piece.column(0).to_pylist())
            short = np.flatnonzero(cut.length <= LONG)
            for u, n in zip(cut.text(short), cut.n[short].tolist()):
                held[u] = held.get(u, 0) + n
            if len(held) > HELD:
                yield from out()
        yield from out()
        give_back()
    return run


class Edges:
    """The piece table of a BPE model as columns: sorted hashes, ids, code points and merges by piece."""

    def __init__(self, model: Pieces):
        rows = [(p, i, m) for p, (i, _) in model.normal.items() for parts, m in [model.merges(p)] if len(parts) == 1]
        self.model, self.longest = model, max((len(p) for p, _, _ in rows), default=1)
        point = np.zeros((len(rows), self.longest), np.uint32)
        merges = np.full((len(rows), self.longest), LAST, np.int64)
        for k, (p, _, m) in enumerate(rows):
            point[k, :len(p)] = [ord(c) for c in p]
            merges[k, :len(m)] = m
        size = np.array([len(p) for p, _, _ in rows], np.int64)
        h = np.array([self.hash(point[k: k + 1, :n])[0] for k, n in enumerate(size)], U)
        order = np.argsort(h)
        self.hashes, self.id = SortedHash(h[order]), np.array([i for _, i, _ in rows], np.int32)[order]
        self.point, self.merges = point[order], merges[order]

    @staticmethod
    def hash(point: np.ndarray) -> np.ndarray:
        return mix(((point.astype(U) + U(1)) * powers(BASE, point.shape[1])).sum(1, dtype=U) + U(point.shape[1]))

    def find(self, point: np.ndarray) -> np.ndarray:
        """Piece that each row of code points is, by hash and then compared; -1 where it is none."""
        at = self.hashes.find(self.hash(point))
        hit = np.flatnonzero(at >= 0)
        at[hit[(self.point[at[hit], :point.shape[1]] != point[hit]).any(1)]] = -1
        return at


def _fold(point: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi over the end positions of units of one length: start and piece (-1: a character that is none) of the best edge to each."""
    units, n = point.shape
    cost = np.full((units, n + 1, n), LAST, np.int64)          # merges of the best path to each position, sorted
    came, piece = np.zeros((units, n + 1), np.int64), np.full((units, n + 1), -1, np.int64)
    for end in range(1, n + 1):
        best = cost[:, end]
        best[:, :max(end - 2, 0)] = cost[:, end - 1, :max(end - 2, 0)]         # the edge of one character
        came[:, end], piece[:, end] = end - 1, edges.find(point[:, end - 1: end])
        for start in range(max(0, end - edges.longest), end - 1):
            at = edges.find(point[:, start: end])
            rows = np.flatnonzero(at >= 0)
            if not len(rows):
                continue
            own = edges.merges[at[rows], :end - start - 1] + start
            new = np.sort(np.concatenate([cost[rows, start, :max(start - 1, 0)], own], 1), 1)
            old = best[rows, :new.shape[1]]
            differ = new != old
            first, k = differ.argmax(1), np.arange(len(rows))
            less = new[k, first] < old[k, first]
            rows, new = rows[less], new[less]
            best[rows] = LAST
            best[rows, :new.shape[1]] = new
            came[rows, end], piece[rows, end] = start, at[rows]
    return came, piece


def _spelled(point: np.ndarray, edges: Edges) -> list[list[int]]:
    """Ids of each unit's best path; all units have one length."""
    came, piece = (x.tolist() for x in _fold(point, edges))
    ids, char, chars = edges.id.tolist(), edges.model.char_ids, {}
    out = []
    for points, back, use in zip(point.tolist(), came, piece):
        path, end = [], len(points)
        while end:
            start, k = back[end], use[end]
            if k >= 0:
                path.append(ids[k])
            else:
                c = points[start]
                if c not in chars:
                    chars[c] = char(chr(c))[::-1]
                path += chars[c]
            end = start
        out.append(path[::-1])
    return out


def _encode_task(shared):
    """(unit, n) -> (unit, n, ids), units of one length at a time, within a bound."""
    def run(batches):
        edges = shared.value
        held, size = [], 0

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            units = table.column("unit").to_pylist()
            length = np.array([len(u) for u in units])
            order = np.argsort(length, kind="stable")
            bounds = np.append(runs(length[order]), len(order))
            for a, b in zip(bounds[:-1], bounds[1:]):
                n = int(length[order[a]])
                step = max(1, FOLDED // (n * n + n))
                for x in range(a, b, step):
                    rows = order[x: min(b, x + step)]
                    point = np.frombuffer("".join([units[i] for i in rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), n)
                    part = table.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("unit", "n")),
                                                      pa.array(_spelled(point, edges), pa.list_(pa.int32()))], names=["unit", "n", "ids"])
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > HELD:
                yield from out()
                held.clear()
                size = 0
        if size:
            yield from out()
        held.clear()
        give_back()
    return run


def _best_path(n, edges, bpe: bool):
    """Viterbi over the end positions: the state holds cost and ids of the best path to each position so far."""
    kind = "array<long>" if bpe else "array<double>"
    start = F.array(F.struct((F.array(F.lit(LAST)) if bpe else F.array(F.lit(0.0))).cast(kind).alias("cost"),
                             F.array().cast("array<int>").alias("ids")))

    def join_cost(old, cost, at):
        if bpe:
            return F.sort_array(F.concat(old, F.transform(cost, lambda m: m + at)))
        return F.array(F.get(old, F.lit(0)) + F.get(cost, F.lit(0)))

    def step(paths, end):
        here = F.filter(edges, lambda e: e["end"] == end)
        return F.concat(paths, F.array(F.array_min(F.transform(here, lambda e: F.struct(
            join_cost(F.get(paths, e["start"])["cost"], e["cost"], e["start"]).alias("cost"),
            F.concat(F.get(paths, e["start"])["ids"], e["ids"]).alias("ids"))))))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda paths: F.element_at(paths, -1)["ids"])


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n) -> (unit, n, ids).  The rows of a unit stay in its partition from the count to the fold."""
    spark = units.sparkSession
    if pieces.bpe:
        edges = spark.sparkContext.broadcast(Edges(pieces))
        return units.select("unit", F.col("n").cast("long").alias("n")).mapInArrow(_encode_task(edges), "unit string, n long, ids array<int>")
    n = F.length("unit")
    spans = (units.withColumn("start", F.explode(F.sequence(F.lit(0), n - 1)))
             .withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("start")))))
             .withColumn("piece", F.substr("unit", F.col("start") + 1, F.col("len"))))
    kind = "array<long>" if pieces.bpe else "array<double>"
    rest = F.array().cast(kind) if pieces.bpe else F.array(F.lit(1e6)).cast(kind)
    hexed = F.hex(F.encode("piece", "UTF-8"))
    fallback = (F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1),
                            lambda k: F.conv(F.substring(hexed, k * 2 + 1, 2), 16, 10).cast("int") + pieces.bytes[0])
                if pieces.bytes else F.array(F.lit(pieces.unknown)))
    # the piece table is the model's vocabulary, a fixed size; a long key makes the look-up cheap, the bytes decide
    table = pieces.table(spark).select(F.xxhash64("piece").alias("h"), F.col("piece").alias("known"), "id", "cost")
    found = F.col("known") == F.col("piece")
    edges = (spans.withColumn("h", F.xxhash64("piece")).join(F.broadcast(table), "h", "left").filter(found | (F.col("len") == 1))
             .select("unit", "n", F.struct((F.col("start") + F.col("len")).alias("end"), "start",
                                           F.when(found, F.array("id")).otherwise(fallback).alias("ids"),
                                           F.when(found, F.col("cost")).otherwise(rest).alias("cost")).alias("edge")))
    lattice = edges.groupBy("unit", "n").agg(F.collect_list("edge").alias("edges"))
    best = lattice.select("unit", "n", _best_path(F.length("unit"), F.col("edges"), pieces.bpe).alias("ids"))
    return best


def hashes(units: list[str]) -> np.ndarray:
    """Spark's xxhash64 of each unit."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(u, SEED) for u in units), U, len(units))


class Hot:
    """Ids of the commonest units: sorted hashes, offsets and one array of ids."""

    def __init__(self, h: np.ndarray, ends: np.ndarray, flat: np.ndarray):
        h, first = np.unique(h, return_index=True)            # of two units of one hash one stays
        size = np.diff(ends)[first]
        self.hashes = SortedHash(h)
        self.ends = np.concatenate([[0], np.cumsum(size)])
        self.flat = flat[np.repeat(ends[:-1][first] - self.ends[:-1], size) + np.arange(self.ends[-1])]


def _hot(known: DataFrame) -> Hot:
    """The commonest units' ids; HOT_UNITS entries of at most LONG ids.

    The count from which a unit is common comes from a histogram of counts in
    eighths of a power of two (at most 512 numbers), so nothing is sorted."""
    short = known.withColumn("step", F.floor(F.log2("n") * 8))
    room, cut = HOT_UNITS, None
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        if r["count"] > room:
            break
        room, cut = room - r["count"], r["step"]
    if cut is None:
        return Hot(np.zeros(0, U), np.zeros(1, np.int64), np.zeros(0, np.int32))
    top = short.filter(F.col("step") >= cut).select("h", "ids").toArrow().combine_chunks()
    size = top.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    flat = top.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    return Hot(top.column("h").to_numpy().view(U), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), flat)


def _rare_units(pieces, hot):
    """(row, h) for the distinct units of a document that are not broadcast."""
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        cut = Cut(pieces.value, piece.column(0).to_pylist())
        short = np.flatnonzero(cut.length <= LONG)
        h = hashes(cut.text(short))
        rare = hot.value.hashes.find(h) < 0
        place = np.full(len(cut.length), -1, np.int64)
        place[short[rare]] = np.flatnonzero(rare)
        at = place[cut.of]
        pair = np.unique(cut.doc[at >= 0] * (len(h) + 1) + at[at >= 0])
        rows = piece.column(1).to_numpy()[pair // (len(h) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(h[pair % (len(h) + 1)].view(np.int64))], names=["row", "h"])
    return run


def _pack(piece: pa.RecordBatch) -> pa.RecordBatch:
    """Texts compressed for the shuffle."""
    c = zstandard.ZstdCompressor(level=6)
    texts = [None if t is None else c.compress(t.encode("utf-8")) for t in piece.column(0).to_pylist()]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), *piece.columns[1:]], names=["packed", *piece.schema.names[1:]])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _unit_ids(cut: Cut, model: Pieces, hot: Hot, rare: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, start, size) of the distinct units: broadcast, looked up for these documents, or long."""
    start, size = (np.zeros(len(cut.length), np.int64) for _ in range(2))
    short = np.flatnonzero(cut.length <= longest)
    h = hashes(cut.text(short))
    at = hot.hashes.find(h)
    hit = at >= 0
    size[short[hit]] = np.diff(hot.ends)[at[hit]]
    flat = [_gather(hot.flat, hot.ends[:-1][at[hit]], size[short[hit]])]
    start[short[hit]] = np.cumsum(size[short[hit]]) - size[short[hit]]
    found = rare.flatten()
    asked = np.repeat(np.arange(len(rare)), pc.fill_null(pc.list_value_length(rare), 0).to_numpy(zero_copy_only=False))
    half = found.field("h").to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF
    own, first = np.unique((asked << 32) | half, return_index=True)
    lists = found.field("ids")
    ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int32)
    left, begin = short[~hit], len(flat[0])
    ask = (cut.doc[cut.one[left]] << 32) | (h[~hit] >> U(32)).astype(np.int64)     # half a hash tells a document's own units apart
    k = first[np.searchsorted(own, ask)] if len(left) else np.zeros(0, np.int64)
    size[left] = (ends[1:] - ends[:-1])[k]
    flat.append(_gather(ids, ends[:-1][k].astype(np.int64), size[left]))
    start[left] = begin + np.cumsum(size[left]) - size[left]
    begin += len(flat[1])
    long = np.flatnonzero(cut.length > longest)
    for i, unit in zip(long, cut.text(long)):
        flat.append(np.array(model.long_ids(unit), np.int32))
        start[i], size[i] = begin, len(flat[-1])
        begin += len(flat[-1])
    return np.concatenate(flat), start, size


def _assemble(pieces, hot):
    """Packed text and its rare units' ids -> ids of the whole text, decoded again to prove the round trip."""
    kept: list = []

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        model, names = pieces.value, piece.schema.names
        if not kept:
            back = {i: bytes([b]) for b, i in model.bytes.items()}
            spelled = [b"" if i in model.special else back.get(i, t.encode("utf-8")) for i, t in enumerate(model.text)]
            kept.extend([zstandard.ZstdDecompressor(), np.frombuffer(b"".join(spelled), np.uint8),
                         np.cumsum([0, *map(len, spelled)])])
        z, flat_bytes, ends = kept
        texts = [z.decompress(t).decode("utf-8") if t is not None else "" for t in piece.column(names.index("packed")).to_pylist()]
        cut = Cut(model, texts)
        flat, start, size = _unit_ids(cut, model, hot.value, piece.column(names.index("rare")), LONG)
        per_unit = size[cut.of]
        ids = _gather(flat, start[cut.of], per_unit)
        lens = np.bincount(cut.doc, per_unit, len(texts)).astype(np.int64)
        bounds = np.cumsum([0, *lens])
        per_id = np.diff(ends)[ids]
        decoded = _gather(flat_bytes, ends[:-1][ids], per_id).tobytes()
        stops = np.concatenate([[0], np.cumsum(per_id)])[bounds].tolist()
        same = [decoded[a:b] == m.encode("utf-8") for a, b, m in zip(stops[:-1], stops[1:], cut.marked)]
        if not all(same):                                     # units that share a hash: encode such a text by itself
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for i in [i for i, x in enumerate(same) if not x]:
                parts[i] = np.array([x for u in model.units(texts[i]) for x in model.long_ids(u)], np.int32)
                same[i] = model.decode(parts[i].tolist()) == texts[i].replace(SPACE, " ")
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        keep = [i for i, x in enumerate(names) if x not in ("packed", "rare", "row", "r_row")]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([*(piece.column(i) for i in keep), lists, pa.array(np.diff(bounds), pa.int32()), pa.array(same, pa.bool_())],
                                          names=[*(names[i] for i in keep), "ids", "n_pieces", "round_trip"])
    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, ids, n_pieces, round_trip.

    ``round_trip`` says that the decoded ids give the text again (the model
    reads the space mark U+2581 as a space).  Null and empty texts have no
    ids.  Very long texts are encoded whole, and so are units without a place
    to cut.  Rows that repeat are rows of their own; an empty table gives an
    empty result.  Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    pieces = Pieces(model)
    shared = spark.sparkContext.broadcast(pieces)
    d = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    units = d.select("text").mapInArrow(_unit_task(shared), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    if not pieces.bpe:
        # a unit grows to dozens of rows, so its few bytes are dealt over many tasks, in which the edges then fit
        units = units.repartition(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), "unit")
    known = stage(encode_units(units, pieces).select(F.xxhash64("unit").alias("h"), "n", "ids"), "piece-units")
    hot = spark.sparkContext.broadcast(_hot(known))
    # rows are told apart by id and text hash; equal rows have equal ids, so they share one lookup
    keyed = d.withColumn("row", F.xxhash64("doc_id", "text"))
    rare = (keyed.select("text", "row").mapInArrow(arrow_job(_rare_units(shared, hot)), "row long, h long")
            .join(known.select("h", "ids"), "h")
            .groupBy("row").agg(F.collect_set(F.struct(F.shiftright("h", 32).cast("int").alias("h"), "ids")).alias("rare")).withColumnRenamed("row", "r_row"))
    rare = stage(rare, "piece-rare")
    drop_stage(known)
    packed = keyed.select("text", "doc_id", "row").mapInArrow(arrow_job(_pack), "packed binary, doc_id long, row long")
    return (packed.join(rare, packed["row"] == rare["r_row"], "left").select("packed", "doc_id", "rare")
            .mapInArrow(arrow_job(_assemble(shared, hot), "packed"),
                        "doc_id long, ids array<int>, n_pieces int, round_trip boolean"))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (with a column ids) with its decoded text; null ids give null."""
    from pyspark.sql import types as T
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model))
    at = encoded.columns.index("ids")

    def run(batches):
        for batch in batches:
            text = [None if ids is None else shared.value.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"])
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
