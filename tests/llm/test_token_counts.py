import pytest
from pyspark.sql import functions as F

from churnwise.llm import token_counts as T


def changes(spark, rows):
    return spark.createDataFrame(rows, T.DELTA)


def totals(roll):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in roll.totals().collect()}


def test_signed_batches_are_idempotent_and_compact(spark, tmp_path):
    roll = T.Rollup(spark, str(tmp_path / "roll"))
    assert totals(roll) == {}
    one = changes(spark, [("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), (None, None, "v1", 1, 7)])
    assert roll.commit("b1", one) and not roll.commit("b1", one)
    rows = spark.createDataFrame([("a", "en", "v1", 10, 12)], "source string, lang string, version string, old long, new long")
    assert roll.commit("b2", T.revisions(rows, F.col("old"), F.col("new")))
    assert totals(roll) == {("a", "en", "v1"): (2, 17), (None, None, "v1"): (1, 7)}
    roll.compact()
    assert roll.committed() == ["b1", "b2"] and not roll.commit("b2", one)
    assert roll.commit("b3", changes(spark, [(None, None, "v1", -1, -7)]))
    assert totals(roll) == {("a", "en", "v1"): (2, 17)}
    # a later session finds the same state
    assert totals(T.Rollup(spark, str(tmp_path / "roll"))) == {("a", "en", "v1"): (2, 17)}


def test_unfinished_batch_is_written_again(spark, tmp_path):
    (tmp_path / "roll/batches/b1").mkdir(parents=True)
    roll = T.Rollup(spark, str(tmp_path / "roll"))
    assert roll.committed() == [] and roll.commit("b1", changes(spark, [("a", "en", "v1", 1, 3)]))
    assert totals(roll) == {("a", "en", "v1"): (1, 3)}


@pytest.mark.parametrize("stop", ["totals", "ids", "DONE"])
def test_compaction_that_stops_half_way(spark, tmp_path, stop):
    roll = T.Rollup(spark, str(tmp_path / "roll"))
    roll.commit("b1", changes(spark, [("a", "en", "v1", 1, 10)]))
    roll.commit("b2", changes(spark, [("a", "en", "v1", 1, 10)]))
    roll.compact()
    roll.commit("b3", changes(spark, [("b", "en", "v1", 1, 4)]))
    want = {("a", "en", "v1"): (2, 20), ("b", "en", "v1"): (1, 4)}
    other = T.Rollup(spark, str(tmp_path / "roll"))
    # as left by a job that died before it wrote ``stop``
    base = tmp_path / "roll/base/00000001"
    if stop != "totals":
        T._summed(other.deltas()).write.parquet(str(base / "totals"))
    if stop == "DONE":
        spark.createDataFrame([("b1",), ("b2",), ("b3",)], "id string").write.parquet(str(base / "ids"))
    assert totals(other) == want and other.committed() == ["b1", "b2", "b3"]
    other.compact()
    assert totals(other) == want and other.committed() == ["b1", "b2", "b3"] and not other.commit("b3", changes(spark, []))
    other.commit("b4", changes(spark, [("b", "en", "v1", -1, -4)]))
    assert totals(other) == {("a", "en", "v1"): (2, 20)}


def test_odd_rows(odd_docs, odd_rows, no_docs):
    import re
    want = {}
    for _, text, lang, source, _ in odd_rows:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        marks = len(re.findall(r"[A-Za-z0-9\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]", text or ""))
        for v, n in (("words-1", words), ("marks-1", marks)):
            d, t = want.get((source, lang, v), (0, 0))
            want[source, lang, v] = (d + 1, t + n)
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in T.token_counts(odd_docs).collect()}
    assert got == want
    assert T.token_counts(no_docs).count() == 0


def test_totals_over_every_document(spark):
    rows = [("one two", "en", "a"), ("日本語の長い文、" * 50, "ja", "b"), (None, "fr", "c"), ("", "fr", "c"), ("a b c d e f", "en", "a")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in T.token_counts(docs).collect()}
    assert got == {("a", "en", "words-1"): (2, 8), ("a", "en", "marks-1"): (2, 8), ("b", "ja", "words-1"): (1, 1), ("b", "ja", "marks-1"): (1, 1),
                   ("c", "fr", "words-1"): (2, 0), ("c", "fr", "marks-1"): (2, 0)}
