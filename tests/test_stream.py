"""Replaying the purchase feed through the stream equals the batch result."""
import os

import pytest
from pyspark.sql import functions as F

from datadirs import SF001
from churnwise.sources.feed import to_payload
from churnwise.sources.testdata import load_purchase_events
from churnwise.streaming import live


def scores(profiles):
    """Customers of a mean order of 50 or more are nurtured, the others are left alone."""
    return profiles.select("customer_id", F.when(F.col("avg_order_value") >= 50, "NURTURE").otherwise("MONITOR").alias("action"),
                           F.lit(0.1).alias("churn_probability"), F.col("monetary_total").alias("predicted_clv"), F.lit("Live").alias("segment"))


def files(folder):
    return sum(n.endswith(".parquet") for _, _, names in os.walk(folder) for n in names)


def test_replay_equals_batch(spark, tmp_path):
    ev = load_purchase_events(spark, SF001)
    as_of = ev.agg(F.max("order_timestamp")).collect()[0][0]
    src, store, ckpt = (str(tmp_path / x) for x in ("src", "store", "ckpt"))
    # four files: three slices of the feed (newest first, so orders arrive out of
    # order), then a re-send of the first slice plus broken events
    parts = [[r.value for r in to_payload(ev.filter(F.col("order_id").cast("long") % 3 == k)).collect()] for k in (2, 0, 1)]
    line = parts[0][0]
    # the same new id twice in one batch: the earlier event wins
    twice = line.replace('"order_id":"', '"order_id":"twice-')
    late = twice.replace('"order_timestamp":"20', '"order_timestamp":"21')
    broken = ["not json", '{"order_id": 5', '["a"]', line.replace('"order_id"', '"other"'), '{"order_id":"x","customer_id":"y"}', "", "   "]
    parts.append(parts[0] + broken + [late, twice])
    os.makedirs(src)
    for i, p in enumerate(parts):
        with open(os.path.join(src, f"{i:03d}.json"), "w") as f:
            f.write("\n".join(p) + "\n")
        os.utime(f.name, (1_700_000_000 + i, 1_700_000_000 + i))       # the source takes the oldest file first
    q = live.start_intake(spark, src, store, ckpt, as_of=as_of, scored=scores, max_files=1, compact_every=2, buckets=4)
    q.awaitTermination(300)

    orders = live.stored(spark, store, "orders")
    n = ev.count()
    assert orders.count() == n + 1
    won = orders.filter(F.col("order_id").startswith("twice-")).collect()
    assert len(won) == 1 and won[0].order_timestamp.year < 2100 and won[0].batch_id == 3
    want = live.profiles(orders, F.lit(as_of)).toPandas().set_index("customer_id").sort_index()
    got = live.current_profiles(spark, store, F.lit(as_of)).toPandas().set_index("customer_id").sort_index()
    assert got.shape == want.shape and (got[want.columns] == want).all().all()
    plain = {tuple(r) for r in orders.filter(~F.col("order_id").startswith("twice-")).drop("batch_id").collect()}
    assert plain == {tuple(r) for r in live.dedupe_batch(ev).select(*orders.drop("batch_id").columns).collect()}

    audit = {r.batch_id: (r.accepted, r.duplicates, r.errors) for r in live.stored(spark, store, "audit").collect()}
    assert audit == {0: (len(parts[0]), 0, 0), 1: (len(parts[1]), 0, 0), 2: (len(parts[2]), 0, 0), 3: (1, len(parts[0]) + 1, 5)}
    reasons = {r.line: r.reason for r in live.stored(spark, store, "quarantine").collect()}
    assert reasons == {"not json": "malformed", '{"order_id": 5': "malformed", '["a"]': "malformed", broken[3]: "missing order_id",
                       broken[4]: "missing total_value, order_timestamp"}
    stats = live.store_stats(spark, store).collect()[0]
    again = live.live_stats(orders, orders).collect()[0]
    assert (stats.db_customers, stats.db_orders, stats.db_total_revenue) == tuple(again)

    # one event for each crossing, found again from the whole history
    fired = [(r.customer_id, r.batch_id) for r in live.stored(spark, store, "activations").collect()]
    sides = None
    for b in range(4):
        seen = spark.createDataFrame([(x,) for x in parts[b]], "value string")
        seen = live.parse_lines(seen).filter("reason IS NULL").select("customer_id").distinct()
        prof = live.profiles(orders.filter(F.col("batch_id") <= b), F.lit(as_of)).join(seen, "customer_id", "left_semi")
        one = prof.select("customer_id", F.lit(b).alias("batch_id"), ((F.col("avg_order_value") >= 50) & (F.col("monetary_total") >= 100)).alias("above"))
        sides = one if sides is None else sides.unionByName(one)
    want = [(r.customer_id, r.batch_id) for r in live.crossings(sides).collect()]
    assert sorted(fired) == sorted(want) and len(set(c for c, _ in fired)) <= len(fired) > 0

    # history is folded, state versions that no manifest names are gone
    assert [s[:2] for s in live._segments(spark, store, "orders")] == [(0, 1)]
    assert live._numbers(spark, os.path.join(store, "orders"), "batch_id") == [2, 3]
    assert len(live._names(spark, os.path.join(store, "manifest"))) == live.KEPT_MANIFESTS


@pytest.mark.parametrize("every", [2])
def test_many_small_batches(spark, tmp_path, every):
    """A batch reads the buckets of its own customers; files stay flat; a retried batch changes nothing."""
    store = str(tmp_path / "store")
    rows = [(f"o{i}", f"c{i % 5}", float(i + 1), None) for i in range(7)]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, total_value double, review_score double").withColumn(
        "order_timestamp", F.lit("2024-01-01").cast("timestamp"))
    counts = []
    for b in range(7):
        one = df.filter(F.col("order_id") == f"o{b}")
        live.process_batch(one, b, store, "2024-02-01", scores, compact_every=every, buckets=16)
        if b in (3, 4):
            live.process_batch(one, b, store, "2024-02-01", scores, compact_every=every, buckets=16)
        counts.append(files(os.path.join(store, "state")) + files(os.path.join(store, "manifest")))
    # a version for each of the five customers' buckets, those of the two manifests before, and the manifests
    assert max(counts) <= 5 + 2 + live.KEPT_MANIFESTS
    state = {r.customer_id: (r.first_batch, r.n_orders, float(r.value_sum)) for r in live.current_state(spark, store).collect()}
    assert state == {"c0": (0, 2, 7.0), "c1": (1, 2, 9.0), "c2": (2, 1, 3.0), "c3": (3, 1, 4.0), "c4": (4, 1, 5.0)}
    assert live.stored(spark, store, "orders").count() == 7 and live.stored(spark, store, "audit").agg(F.sum("accepted")).first()[0] == 7
    # a compaction that stopped after its segment was written: its folders are left out
    seg = live._segments(spark, store, "orders")[0]
    spark.read.parquet(seg[2]).filter("batch_id = 0").write.partitionBy("batch_id").mode("append").parquet(os.path.join(store, "orders"))
    assert live.stored(spark, store, "orders").count() == 7
    live.compact(spark, store, 3)
    assert 0 not in live._numbers(spark, os.path.join(store, "orders"), "batch_id") and live.stored(spark, store, "orders").count() == 7


def test_empty_store(spark, tmp_path):
    store = str(tmp_path / "none")
    assert live.stored(spark, store, "orders") is None and live.current_state(spark, store).count() == 0
    assert tuple(live.store_stats(spark, store).first()) == (0, 0, 0.0)
    live.process_batch(load_purchase_events(spark, SF001).limit(0), 0, store, "2024-01-01", scores)
    assert live.current_profiles(spark, store, "2024-01-01").count() == 0
