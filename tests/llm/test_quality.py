import numpy as np
import pyarrow as pa

from churnwise.llm import quality as Q
from churnwise.llm.common import read

SF = "/root/testdata/sf0.01"


def test_statistics_by_hand():
    stats, _ = Q.statistics(pa.array(["AB cd!! cd!! 12", "", None, "x\nx\nx\ny\n"]))
    name = {n: i for i, (n, _, _) in enumerate(Q.LABELLERS)}
    row = stats[0]
    assert row[name["upper_share"]] == 2 / 6 and row[name["exclamations_per_word"]] == 1.0
    assert row[name["repeated_neighbours"]] == 1 / 4 and row[name["words"]] == 4
    assert row[name["letter_share"]] == 6 / 12 and row[name["bytes_per_word"]] == 3.0
    assert np.isnan(stats[1][name["upper_share"]]) and stats[2][name["words"]] == 0
    assert stats[3][name["repeated_lines"]] == 0.5


def test_patterns_round_trip():
    v = np.random.default_rng(0).integers(0, 3, (50, len(Q.LABELLERS)))
    assert (Q.unpattern(Q.pattern(v)) == v).all()


def test_em_recovers_kinds_of_bad_documents():
    rng = np.random.default_rng(1)
    m, n = len(Q.LABELLERS), 20_000
    truth = rng.choice([-1, 0, 1, 2], n, p=[0.85, 0.05, 0.05, 0.05])      # good, or bad of kind 0, 1, 2
    v = np.where(rng.random((n, m)) < 0.9, Q.GOOD, Q.NONE)
    for k in range(3):
        v[truth == k, k] = Q.BAD
    v[(truth == -1) & (rng.random(n) < 0.001), 4] = Q.BAD                # false alarms
    code, count = np.unique(Q.pattern(v), return_counts=True)
    model = Q.WeakLabels(code, count.astype(float))
    assert abs(model.share[0] - 0.85) < 0.02
    good = model.posterior(v) >= 0.5
    assert np.mean(good == (truth == -1)) > 0.995
    assert (model.accuracy() > 0.5).all()


def test_agrees_with_human_labels_it_never_read(spark):
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    rows = [r for r in Q.classify(read(spark, SF, "documents")).collect() if r.doc_id in labels]
    assert np.mean([r.kept == bool(labels[r.doc_id]) for r in rows]) > 0.95
    assert np.mean([r.kept for r in rows if labels[r.doc_id] == 1]) > 0.99


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = Q.classify(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    assert all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in rows)
    same = {(r.score, r.weak_label) for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1
    assert Q.classify(no_docs).count() == 0


def test_sample_weighs_copies(spark):
    texts = spark.createDataFrame([("hot",)] * 400 + [(f"own {i}",) for i in range(600)], "text string").repartition(4)
    rows = {r.text: r.weight for r in Q.training_rows(texts, 1000, room=100).collect()}
    assert rows.pop("hot") == 40.0 and set(rows.values()) == {1.0} and 30 < len(rows) < 95
    whole = Q.training_rows(texts, 1000).collect()
    assert len(whole) == 601 and sum(r.weight for r in whole) == 1000


def test_em_document_by_document():
    """Shares and rates of the folded patterns are those of plain loops over documents."""
    rng = np.random.default_rng(7)
    m = len(Q.LABELLERS)
    v = rng.choice(3, (60, m), p=[0.1, 0.3, 0.6])
    code, count = np.unique(Q.pattern(v), return_counts=True)
    model = Q.WeakLabels(code, count.astype(float), rounds=3)
    post = []
    for row in v:
        bad = [int(x == Q.BAD) for x in row]
        post.append([0.2, *[0.8 * b / sum(bad) for b in bad]] if sum(bad) else [0.95, *[0.05 / m] * m])
    for _ in range(3):
        share = [(sum(p[c] for p in post) + 1) / (len(v) + m + 1) for c in range(m + 1)]
        rates = [[[0.0] * 3 for _ in range(m)] for _ in range(m + 1)]
        for c in range(m + 1):
            for j in range(m):
                votes = [sum(p[c] for p, row in zip(post, v) if row[j] == k) + 1 for k in range(3)]
                r = [x / sum(votes) for x in votes]
                low, high = (Q.WeakLabels.OWN, 1.0) if c == j + 1 else (0.0, Q.WeakLabels.FALSE_BAD) if c == 0 else (0.0, 1.0)
                want = min(max(r[Q.BAD], low), high)
                rates[c][j] = [want if k == Q.BAD else r[k] * (1 - want) / max(1 - r[Q.BAD], 1e-12) for k in range(3)]
        post = []
        for row in v:
            p = [share[c] * np.prod([rates[c][j][row[j]] for j in range(m)]) for c in range(m + 1)]
            post.append([x / sum(p) for x in p])
    assert np.allclose(model.share, share) and np.allclose(model.rates, rates)
    assert np.allclose(model.posterior(v), [p[0] for p in post])
