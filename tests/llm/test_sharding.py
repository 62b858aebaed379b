import zlib

from pyspark.sql import functions as F

from churnwise.llm import sharding as S


def test_permutation_and_its_inverse():
    for n in (0, 1, 2, 3, 5, 16, 17, 99, 1000, 4097):
        p = S.Permutation(n, 5)
        seen = [p.position(i) for i in range(n)]
        assert sorted(seen) == list(range(n)) and [p.row_at(x) for x in seen] == list(range(n))
    assert [S.Permutation(1000, 1).position(i) for i in range(50)] != [S.Permutation(1000, 2).position(i) for i in range(50)]
    big = S.Permutation(10**15 + 37, 3)
    assert all(big.row_at(big.position(i)) == i for i in range(0, 10**15, 10**13 + 7))


def test_shuffle_is_even():
    """Neighbouring rows land on unrelated positions: shards of a prefix fill evenly."""
    p = S.Permutation(100_000)
    counts = [0] * 16
    for i in range(16_000):
        counts[p.position(i) % 16] += 1
    assert sum((c - 1000) ** 2 / 1000 for c in counts) < 45       # chi-square, 15 degrees of freedom


def check(rows, texts, shards):
    want = [(i, t or "") for i, t in texts]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in want)
    slots = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    p = S.Permutation(len(rows))
    for r in rows:                                                   # computable from the number, and back
        assert p.position(r.row_number) == r.slot * shards + r.shard and p.row_at(r.slot * shards + r.shard) == r.row_number


def test_odd_rows(odd_docs, odd_rows, no_docs):
    texts = [(r[0], r[1]) for r in odd_rows]
    for shards in (1, 4, 16):
        check(S.shard_assignment(odd_docs, shards).collect(), texts, shards)
    assert S.shard_assignment(no_docs).count() == 0
    one = sorted(map(tuple, S.shard_assignment(odd_docs).select("doc_id", "shard", "slot").collect()), key=str)
    two = sorted(map(tuple, S.shard_assignment(odd_docs.repartition(7)).select("doc_id", "shard", "slot").collect()), key=str)
    assert one == two


def test_ranges_and_large_folds(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 50)
    monkeypatch.setattr(S, "UNFOLD", 7)
    rows = [(i % 300, f"text {i % 300}") for i in range(600)] + [(None, "copy")] * 100 + [(7, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(S.shard_assignment(docs).collect(), rows, 16)


def test_all_columns(odd_docs, odd_rows, no_docs):
    out = S.sharded_documents(odd_docs, 4)
    assert out.columns == [*odd_docs.columns, "shard_", "slot_"]
    got = out.collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(str(r) for r in odd_rows)
    assert sorted((r["slot_"], r["shard_"]) for r in got) == [(i // 4, i % 4) for i in range(len(odd_rows))]
    assert S.sharded_documents(no_docs).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    S.write_shards(docs, str(tmp_path / "a"), 4, file_rows=100)
    S.write_shards(docs.repartition(3), str(tmp_path / "b"), 4, file_rows=100)
    one, two = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    assert one.count() == 1000 and one.exceptAll(two).isEmpty()
    shard = spark.read.parquet(str(tmp_path / "a/shard=1"))
    by_file = shard.withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list("slot").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.n <= 100 for r in by_file) and sorted(x for r in by_file for x in r.s) == list(range(250))
    p = S.Permutation(1000)                                           # a slot's row is computed, not looked up
    assert {r.slot: r.doc_id for r in shard.collect()}[17] == p.row_at(17 * 4 + 1)
