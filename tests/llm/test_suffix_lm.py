import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from churnwise.llm import suffix_lm as S
from churnwise.llm.common import read
from churnwise.llm.textkit import U

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def base(rows):
    """The contract's base score by its definition."""
    train = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    return n, [(len(tokens(t)), sum(train[x] > 0 for x in tokens(t)),
                sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))) for _, t in rows]


def check(df, rows):
    n, want = base(rows)
    got = df.collect()
    assert len(got) == len(rows) and all(r.train_tokens == n for r in got)
    a = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in got)
    b = sorted((str(i), *w) for (i, _), w in zip(rows, want))
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], rel=1e-9)
    return got


def test_base_score_of_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_WORDS", 50)                  # most words go by the join
    docs = read(spark, SF, "documents")
    check(S.score_texts(docs), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = check(S.score_texts(odd_docs), [(r[0], r[1]) for r in odd_rows])
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1           # the end alone
    assert S.score_texts(no_docs).count() == 0


def symbols_of(text):
    words = tokens(text)[:-1]
    return " ".join(words).encode() + b"\n"


def brute_tree(texts):
    """The tree by dictionaries: states, and the probability of a symbol after a history."""
    counts = [Counter() for _ in range(S.DEPTH + 1)]
    for t in texts:
        s = bytes([S.START] * S.DEPTH) + symbols_of(t)
        for i in range(S.DEPTH, len(s)):
            for d in range(S.DEPTH + 1):
                counts[d][s[i - d: i], s[i]] += 1
    total = sum(counts[0].values())
    follow = [{} for _ in counts]
    for d, c in enumerate(counts):
        for (ctx, x), n in c.items():
            follow[d].setdefault(ctx, {})[x] = n
    states = {b"": follow[0].get(b"", {})}
    for d in range(1, S.DEPTH + 1):
        for ctx, nxt in follow[d].items():
            n, up = sum(nxt.values()), follow[d - 1][ctx[1:]]
            m = sum(up.values())
            gain = sum(k * math.log((k / n) / (up[x] / m)) for x, k in nxt.items())
            if n >= total * S.MIN_SHARE and gain > S.GAIN * len(nxt):
                states[ctx] = nxt

    def p(history, x):
        if history in states:
            nxt = states[history]
            n, k = sum(nxt.values()), S.SMOOTH * len(nxt)
            low = p(history[1:], x) if history else 1 / S.ALPHABET
            return (nxt.get(x, 0) + k * low) / (n + k)
        return p(history[1:], x)
    return states, p


def test_scores_match_the_tree_by_its_definition(spark, monkeypatch):
    monkeypatch.setattr(S, "MIN_SHARE", 0.002)
    texts = ["the cat and the hat", "The  hat on the mat and that cat", "", "a thing that the cat has", "on and on and on"] * 4
    rows = [(i, t) for i, t in enumerate(texts)]
    trained = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    states, p = brute_tree(trained)
    assert any(len(s) > 1 for s in states)
    got = {r.doc_id: r.score for r in S.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        s = bytes([S.START] * S.DEPTH) + symbols_of(t)
        want = sum(math.log10(p(s[j - S.DEPTH: j], s[j])) for j in range(S.DEPTH, len(s)))
        assert got[i] == pytest.approx(want, rel=1e-9)
    # next-symbol distributions sum to one in every state
    alphabet = [b for b in range(256) if b not in (0x09, 0x0B, 0x0C, 0x0D)]
    assert len(alphabet) == S.ALPHABET
    for state in list(states)[:50]:
        assert sum(p(state, x) for x in alphabet) == pytest.approx(1)


def test_codes_read_words_separators_and_end():
    code, doc = S.codes(pa.array(["  Ab  c ", None, "x"]))
    assert bytes((code & U(255)).astype(np.uint8)) == b"ab c\n" + b"\n" + b"x\n"
    assert doc.tolist() == [0] * 5 + [1] + [2] * 2
    assert all(int(code[i]) >> 8 == int.from_bytes(bytes([S.START] * S.DEPTH), "big") for i in (0, 5, 6))


def test_model_beats_a_uniform_guess_on_held_out_text(spark):
    rows = S.score_texts(read(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").collect()
    docs = {r.doc_id: r.text for r in read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()}
    n = sum(len(symbols_of(docs[r.doc_id])) for r in rows)
    assert sum(r.score for r in rows) > -0.75 * n             # log10(252) is 2.4 a symbol


def test_rare_contexts_are_states_at_every_size(spark, monkeypatch):
    texts = ["the cat and the hat", "The  hat on the mat and that cat", "a thing that the cat has", "on and on and on", "zqx zqx", "zqy zqx é"] * 6
    rows = [(i, t) for i, t in enumerate(texts)]
    trained = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    monkeypatch.setattr(S, "MIN_SHARE", 0.0)                  # by definition: no share is asked for
    states, p = brute_tree(trained)
    for s in [s for s, n in states.items() if s and sum(n.values()) < 2]:
        del states[s]
    monkeypatch.setattr(S, "ROOT_ROWS", 200)                  # several tasks
    for share in (0.02, 2.0):                                 # few common contexts, none but the empty one
        monkeypatch.setattr(S, "MIN_SHARE", share)
        got = {r.doc_id: r.score for r in S.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i, t in rows:
            s = bytes([S.START] * S.DEPTH) + symbols_of(t)
            assert got[i] == pytest.approx(sum(math.log10(p(s[j - S.DEPTH: j], s[j])) for j in range(S.DEPTH, len(s))), rel=1e-9)


def test_same_evidence_makes_a_state_in_a_larger_corpus(spark, monkeypatch):
    texts = ["zqx zqx", "zqy zqx"] * 3 + ["the cat and the hat on a mat " * 14000] * 2
    rows = [(i, t) for i, t in enumerate(texts)]
    trained = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert sum(map(len, trained)) > 400_000                   # a share of 1e-5 is a count of 4 and more
    got = {r.doc_id: r.score for r in S.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(S, "MIN_SHARE", 0.0)
    states, p = brute_tree(trained)
    for s in [s for s, n in states.items() if s and sum(n.values()) < 2]:
        del states[s]
    for i, t in rows[:6]:
        s = bytes([S.START] * S.DEPTH) + symbols_of(t)
        assert got[i] == pytest.approx(sum(math.log10(p(s[j - S.DEPTH: j], s[j])) for j in range(S.DEPTH, len(s))), rel=1e-9)


def test_packed_codes_come_back():
    code = np.array([0, 5, 5 + (1 << 40), (6 << 56) + 3], np.uint64)
    times = np.array([1, 70000, 2, 3], np.int64)
    got = S.unpack(S.pack(code, times))
    assert got[0].tolist() == code.tolist() and got[1].tolist() == times.tolist()
    assert S.pack(code[:0], times[:0]) is None


@pytest.mark.parametrize("hot", [0, 40, 1 << 21])
def test_hot_codes_are_scored_like_the_others(spark, monkeypatch, hot):
    texts = ["the cat and the hat", "The  hat on the mat and that cat", "a thing that the cat has", "zqx zqx", "zqy zqx é"] * 6
    rows = [(i, t) for i, t in enumerate(texts)]
    trained = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    monkeypatch.setattr(S, "MIN_SHARE", 0.0)                  # by definition: no share is asked for
    states, p = brute_tree(trained)
    for s in [s for s, n in states.items() if s and sum(n.values()) < 2]:
        del states[s]
    monkeypatch.setattr(S, "MIN_SHARE", 0.02)
    monkeypatch.setattr(S, "HOT_CODES", hot)
    asked = []
    whole_stage = S.stage

    def seen(df, name):
        out = whole_stage(df, name)
        if name == "lm-scored":
            asked.append(out.agg({"asked": "sum"}).first()[0])
        return out
    monkeypatch.setattr(S, "stage", seen)
    got = {r.doc_id: r.score for r in S.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        s = bytes([S.START] * S.DEPTH) + symbols_of(t)
        assert got[i] == pytest.approx(sum(math.log10(p(s[j - S.DEPTH: j], s[j])) for j in range(S.DEPTH, len(s))), rel=1e-9)
    assert (asked == [0]) == (hot == 1 << 21)                 # every text is also trained on: nothing is left to ask for
