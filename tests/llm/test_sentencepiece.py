import itertools
import random
import re

import numpy as np
import pytest

from churnwise.llm import sentencepiece_lattice as P
from churnwise.llm.common import read

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["", None, " ", "a", "  two  spaces ", "Hello, world!\nNew  line\ttab", "日本語のテキスト 😀 naïve Größe", "aaaaaaa bbbb",
         "x" * 300 + "ing" * 100, "=" * 40 + "-" * 33 + "....", "3.14159 1,000,000 v2", "a\x00b\r\n\r\nc", " " * 70 + "end",
         "ONE.*** two,%%% $$$$$ ((()))", "ñrrcoado ciónesrr öüß", "<s> </s> <unk> <0x41>", "▁mark"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def encoded(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in P.encode(df).collect()}


def test_ids_equal_the_librarys(spark, library):
    rng = random.Random(4)
    rows = list(enumerate(TEXTS))
    rows += [(100 + i, "".join(rng.choice("abehinrst ,.*$A1é\n") for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    rows += [(1000 + r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").limit(60).collect()]
    got = encoded(spark, rows)
    assert len(got) == len(rows)
    for i, t in rows:
        assert list(got[i].ids) == (library.encode(t) if t else []), repr(t)
        assert got[i].n_pieces == len(got[i].ids) and got[i].round_trip


def test_decoding_gives_the_text_again(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t and P.SPACE not in t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = {r.doc_id: r.decoded for r in P.decode(P.encode(df)).collect()}
    assert back == dict(rows)
    pieces = P.Pieces(P.MODEL)
    ids = [1, 13, 349, 2, 3 + 0xC3, 3 + 0xA9]
    assert pieces.decode(ids) == library.decode(ids)


def test_units_cut_only_where_no_piece_joins():
    pieces = P.Pieces(P.MODEL)
    for t in TEXTS:
        if t:
            units = pieces.units(t)
            assert "".join(units) == (P.SPACE + t).replace(" ", P.SPACE)
            assert [x for u in units for x in pieces.merges(u)[0]] == pieces.merges("".join(units))[0]


def test_rare_and_long_units_take_the_other_paths(spark, library, monkeypatch):
    monkeypatch.setattr(P, "HOT_UNITS", 3)
    monkeypatch.setattr(P, "LONG", 5)
    rows = [(i, t) for i, t in enumerate(TEXTS) if t]
    got = encoded(spark, rows)
    assert all(list(got[i].ids) == library.encode(t) for i, t in rows)


def test_units_of_one_hash_do_not_mix(spark, library, monkeypatch):
    monkeypatch.setattr(P, "_hot", lambda known: P.Hot(P.hashes(["▁hello"]), np.array([0, 2]), np.array([5, 6], np.int32)))
    got = encoded(spark, [(1, "hello there"), (2, "there")])
    assert [list(got[i].ids) for i in (1, 2)] == [library.encode("hello there"), library.encode("there")]
    assert got[1].round_trip and got[2].round_trip


def test_hashes_are_sparks(spark):
    from pyspark.sql import functions as F
    units = ["a", "▁the", "x" * 70, "日本語のテ"]
    rows = spark.createDataFrame([(u,) for u in units], "u string").select("u", F.xxhash64("u").alias("h")).collect()
    assert {r.u: r.h for r in rows} == dict(zip(units, P.hashes(units).view(np.int64).tolist()))


def test_unigram_costs_match_all_segmentations(spark):
    pieces = P.Pieces.__new__(P.Pieces)
    pieces.bpe, pieces.prefix, pieces.bytes, pieces.unknown, pieces.longest = False, False, {}, 0, 4
    pieces.text, pieces.special, pieces.rank = ["<unk>"], set(), {}
    rng = random.Random(7)
    pieces.normal = {c: (i + 1, -8.0 - i / 7) for i, c in enumerate("abc")}
    for n in (2, 3, 4):
        for p in itertools.islice(itertools.product("abc", repeat=n), 0, None, 2):
            pieces.normal["".join(p)] = (len(pieces.normal) + 1, -rng.uniform(3, 20))
    pieces.pattern = re.compile("(?s).+")
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    units = spark.createDataFrame([(w, 1) for w in sorted(set(words))], "unit string, n long")
    for r in P.encode_units(units, pieces).collect():
        best = None
        for cuts in itertools.product([0, 1], repeat=len(r.unit) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(r.unit)]
            parts = [r.unit[a:b] for a, b in zip(at, at[1:])]
            if all(p in pieces.normal for p in parts):
                score = sum(pieces.normal[p][1] for p in parts)
                if best is None or score > best[0] + 1e-12:
                    best = (score, [pieces.normal[p][0] for p in parts])
        assert list(r.ids) == best[1], r.unit
        assert pieces.long_ids(r.unit) == best[1]
    unit = "".join(rng.choice("abcd") for _ in range(P.LONG * 4))
    lattice = P.encode_units(spark.createDataFrame([(unit, 1)], "unit string, n long"), pieces).first().ids
    assert pieces.long_ids(unit) == list(lattice)


def test_odd_rows(odd_docs, odd_rows, no_docs, library):
    rows = P.encode(odd_docs).collect()
    want = sorted((str(r[0]), library.encode(r[1]) if r[1] else []) for r in odd_rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
    assert P.encode(no_docs).count() == 0


def test_cuts_as_columns_equal_the_pattern():
    pieces = P.Pieces(P.MODEL)
    cut = P.Cut(pieces, TEXTS)
    got = [[] for _ in TEXTS]
    for doc, a, b in zip(cut.doc, cut.start, cut.end):
        got[doc].append(cut.whole[a:b])
    assert got == [pieces.units(t) for t in TEXTS]
    words = cut.text(np.arange(len(cut.one)))
    assert [words[i] for i in cut.of] == [u for units in got for u in units] and len(set(words)) == len(words)


def test_paths_folded_as_columns_equal_the_merges():
    pieces = P.Pieces(P.MODEL)
    edges = P.Edges(pieces)
    rng = random.Random(9)
    for n in (1, 2, 3, 7, 20, 40):
        units = ["".join(rng.choice("▁aaeehinrrsttu.,!é日") for _ in range(n)) for _ in range(200)]
        point = np.array([[ord(c) for c in u] for u in units], np.uint32)
        assert P._spelled(point, edges) == [pieces.long_ids(u) for u in units]
