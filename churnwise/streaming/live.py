"""Live order intake on Structured Streaming.

Order events arrive as JSON lines; each micro-batch runs :func:`process_batch`
in ``foreachBatch``:

* S4  a line that is no JSON, and an event without a required field, go to the
      quarantine table with the line as it came and the reason;
* T1  an order id is accepted once: Spark's own streaming ``dropDuplicates``
      keeps the ids in its state store (RocksDB, checkpointed with the query),
      so no batch reads the order history and no Python runs per id; of equal
      new ids in a batch the earliest event wins; a static batch falls back to
      ``left_anti`` against the stored ids;
* T5  arrivals and new ids come through one stream, so accepted, duplicate and
      broken events are counted per batch;
* T2, T4, T6  one state row per customer (first batch, mergeable order
      statistics, last side of the activation rule) lives in a table of
      ``buckets`` customer-hash buckets.  A batch reads and rewrites the
      buckets of its own customers only; a manifest per batch names the
      current version of every bucket, and versions that no recent manifest
      names are deleted;
* T6  an event fires when a customer crosses to the side where the rule holds,
      once per crossing;
* T3, S5  orders, counts, quarantine and activations are written per batch;
      every ``compact_every`` batches the finished ones fold into a segment.

A retried batch reads the manifest of its predecessor and rewrites its own
partitions and versions, so a retry gives the same rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise import config
from churnwise.functions.scalar import day_diff, money, round_half_even
from churnwise.operators import actions
from churnwise.session import path_exists
from churnwise.sources.schemas import ORDER_EVENT

REQUIRED = ("order_id", "customer_id", "total_value", "order_timestamp")
EVENT_COLS = ("order_id", "customer_id", "total_value", "order_timestamp", "review_score")
#: Customer-hash buckets of the state table, and manifests whose versions are kept.
BUCKETS, KEPT_MANIFESTS = 64, 3
#: Tables that grow by batch and are compacted.
HISTORY = ("orders", "audit", "quarantine", "activations")


# ---- files ---------------------------------------------------------------

def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None while it does not exist (asked in the path's own store)."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def _write(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    """Values of the partition folders ``key=N`` under ``path``."""
    return sorted(int(n.split("=")[1]) for n in _names(spark, path) if n.startswith(f"{key}="))


def _segments(spark: SparkSession, store: str, table: str) -> list[tuple[int, int, str]]:
    """(first batch, last batch, path) of the finished segments of a table."""
    base = os.path.join(store, "segments", table)
    out = []
    for n in _names(spark, base):
        if path_exists(spark, f"{base}/{n}/_SUCCESS"):
            first, last = n.split("-")
            out.append((int(first), int(last), f"{base}/{n}"))
    return sorted(out)


def stored(spark: SparkSession, store: str, table: str, before: int | None = None) -> DataFrame | None:
    """A history table with its ``batch_id``: finished segments and the batches beside them, None while there is nothing."""
    segments = _segments(spark, store, table)
    raw = os.path.join(store, table)
    loose = [b for b in _numbers(spark, raw, "batch_id") if not any(lo <= b <= hi for lo, hi, _ in segments)]
    frames = [spark.read.parquet(p) for _, _, p in segments]
    if loose:
        frames.append(spark.read.option("basePath", raw).parquet(*[f"{raw}/batch_id={b}" for b in loose]).withColumn("batch_id", F.col("batch_id").cast("long")))
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out if out is None or before is None else out.filter(F.col("batch_id") < before)


def compact(spark: SparkSession, store: str, before: int) -> None:
    """Fold the finished batches below ``before`` of every history table into one segment each, then delete their folders.

    The segment counts once it is complete; from then on the folders are not
    read, so a stop between the two steps loses and doubles nothing.
    """
    for table in HISTORY:
        raw, done = os.path.join(store, table), _segments(spark, store, table)
        batches = [b for b in _numbers(spark, raw, "batch_id") if b < before]
        loose = [b for b in batches if not any(lo <= b <= hi for lo, hi, _ in done)]
        if loose:
            rows = spark.read.option("basePath", raw).parquet(*[f"{raw}/batch_id={b}" for b in loose])
            (rows.withColumn("batch_id", F.col("batch_id").cast("long")).hint("rebalance")
             .write.mode("overwrite").parquet(os.path.join(store, "segments", table, f"{loose[0]}-{loose[-1]}")))
        for b in batches:
            _delete(spark, f"{raw}/batch_id={b}")


# ---- events --------------------------------------------------------------

def valid_rows(df: DataFrame) -> Column:
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull()
    return ok


def parse_lines(lines: DataFrame) -> DataFrame:
    """(value) to the event columns, ``line`` and ``reason``; the reason is null for a good event.

    A blank line is no event.  A line that is no JSON object of the schema is
    ``malformed``; an event without a required field names the missing ones.
    """
    schema = T.StructType([*ORDER_EVENT.fields, T.StructField("_bad", T.StringType())])
    rows = lines.filter(F.trim("value") != "").withColumn("e", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}))
    missing = F.concat_ws(", ", *[F.when(F.col(f"e.{c}").isNull(), F.lit(c)) for c in REQUIRED])
    reason = (F.when(F.col("e").isNull() | F.col("e._bad").isNotNull(), F.lit("malformed"))
              .when(missing != "", F.concat(F.lit("missing "), missing)))
    return rows.select(*[F.col(f"e.{c}").alias(c) for c in EVENT_COLS], F.col("value").alias("line"), reason.alias("reason"))


def quarantined(lines: DataFrame) -> DataFrame:
    """S4 over a whole feed of lines: the broken ones with their reason."""
    return parse_lines(lines).filter("reason IS NOT NULL").select("line", "reason")


def dedupe_batch(df: DataFrame) -> DataFrame:
    """T1 inside one batch: one row per order id; the earliest timestamp (then
    the lowest customer id and value) wins, so the choice is repeatable."""
    key = F.struct("order_timestamp", "customer_id", "total_value", "review_score")
    return (df.groupBy("order_id").agg(F.min(key).alias("k"))
            .select("order_id", "k.customer_id", "k.total_value", "k.order_timestamp", "k.review_score"))


# ---- customer state --------------------------------------------------------

STATE_COLS = ("n_orders", "value_sum", "first_purchase", "last_purchase", "review_sum", "review_n")


def profile_state(orders: DataFrame) -> DataFrame:
    """Mergeable per-customer statistics of a set of orders."""
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(money("total_value")).alias("value_sum"),
        F.min("order_timestamp").alias("first_purchase"),
        F.max("order_timestamp").alias("last_purchase"),
        F.sum("review_score").alias("review_sum"),
        F.count("review_score").alias("review_n"))


def merge_state(*states: DataFrame) -> DataFrame:
    """Combine state rows of the same customers (sums add, min / max combine, the first batch and the last side stay)."""
    u = states[0]
    for s in states[1:]:
        u = u.unionByName(s)
    return u.groupBy("customer_id").agg(
        F.min("first_batch").alias("first_batch"),
        F.sum("n_orders").alias("n_orders"), F.sum("value_sum").cast("decimal(38,6)").alias("value_sum"),
        F.min("first_purchase").alias("first_purchase"), F.max("last_purchase").alias("last_purchase"),
        F.sum("review_sum").alias("review_sum"), F.sum("review_n").alias("review_n"), F.bool_or("above").alias("above"))


def profiles_from_state(state: DataFrame, as_of) -> DataFrame:
    """T4 profile columns; recency against ``as_of`` (the clock of the reader)."""
    as_of_col = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    value = F.coalesce(F.col("value_sum").cast("double"), F.lit(0.0))
    return state.filter("n_orders > 0").select(
        "customer_id",
        day_diff(as_of_col, "last_purchase").alias("recency_days"),
        F.col("n_orders").alias("frequency_count"),
        value.alias("monetary_total"),
        (value / F.col("n_orders")).alias("avg_order_value"),
        (F.col("review_sum") / F.col("review_n")).alias("avg_review_score"),
        "first_purchase", "last_purchase")


def profiles(orders: DataFrame, as_of) -> DataFrame:
    """T4 over a set of orders in one go (the batch twin of the stream)."""
    return profiles_from_state(profile_state(orders), as_of)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, store: str, before: int | None = None) -> dict[int, int]:
    """Bucket to version of the state after the last batch (below ``before``): at most one entry per bucket."""
    base = os.path.join(store, "manifest")
    done = [b for b in _numbers(spark, base, "batch_id") if before is None or b < before]
    return {r.bucket: r.version for r in spark.read.parquet(f"{base}/batch_id={done[-1]}").collect()} if done else {}


def _state_rows(spark: SparkSession, store: str, versions: dict[int, int]) -> DataFrame | None:
    """State rows of the given buckets in the given versions; only their folders are opened."""
    base = os.path.join(store, "state")
    paths = [f"{base}/batch_id={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def _put_state(spark: SparkSession, store: str, batch_id: int, merged: DataFrame, touched: list[int], before: dict[int, int], buckets: int) -> None:
    """Write the touched buckets as version ``batch_id``, then the manifest, then delete versions that no kept manifest names."""
    base = os.path.join(store, "state")
    (merged.withColumn("bucket", bucket_of(buckets)).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/batch_id={batch_id}"))
    now = {**before, **dict.fromkeys(touched, batch_id)}
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
        os.path.join(store, "manifest", f"batch_id={batch_id}"))
    manifests = [b for b in _numbers(spark, os.path.join(store, "manifest"), "batch_id") if b <= batch_id]
    kept = manifests[-KEPT_MANIFESTS:]
    used: set[tuple[int, int]] = set()
    for b in kept:
        used |= set(_manifest(spark, store, before=b + 1).items())
    for v in _numbers(spark, base, "batch_id"):
        held = _numbers(spark, f"{base}/batch_id={v}", "bucket")
        gone = [b for b in held if v < batch_id and (b, v) not in used]
        for path in [f"{base}/batch_id={v}"] if len(gone) == len(held) else [f"{base}/batch_id={v}/bucket={b}" for b in gone]:
            _delete(spark, path)
    for b in manifests[:-KEPT_MANIFESTS]:
        _delete(spark, os.path.join(store, "manifest", f"batch_id={b}"))


# ---- activation --------------------------------------------------------------

def crossings(sides: DataFrame, key: str = "customer_id", order: str = "batch_id", side: str = "above") -> DataFrame:
    """T6 over a whole history of sides (one row per key and batch): the rows where the side turns true (the first row counts
    from false)."""
    last = F.lag(side).over(Window.partitionBy(key).orderBy(order))
    return sides.withColumn("_last", F.coalesce(last, F.lit(False))).filter(F.col(side) & ~F.col("_last")).drop("_last")


# ---- batches -----------------------------------------------------------------

def process_batch(batch: DataFrame, batch_id: int, store: str, as_of=None,
                  scored: DataFrame | Callable[[DataFrame], DataFrame] | None = None, params=None,
                  compact_every: int = 50, buckets: int = BUCKETS) -> None:
    """One micro-batch of the intake (see the module notes).

    ``batch`` has the event columns, and from the stream also ``line``,
    ``reason`` and ``first_seen`` (true on the one row per new order id that
    the state store lets pass).  ``scored`` is a table of scored customers, or
    a function from the touched customers' profiles to such a table.
    """
    spark = batch.sparkSession
    if "reason" not in batch.columns:
        batch = batch.withColumns({"line": F.lit(None).cast("string"), "reason": F.when(~valid_rows(batch), F.lit("missing field"))})
    # several tables are written from the batch: the source and the state store run once
    batch = batch.persist()
    try:
        _store_batch(spark, batch, int(batch_id), store, as_of, scored, params, buckets)
    finally:
        batch.unpersist()
    if compact_every and batch_id and batch_id % compact_every == 0:
        compact(spark, store, int(batch_id))


def _store_batch(spark, batch, batch_id, store, as_of, scored, params, buckets) -> None:
    bid = F.lit(batch_id).cast("long")
    as_of_col = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    arrivals, new_ids = batch, None
    if "first_seen" in batch.columns:
        arrivals, new_ids = batch.filter("NOT first_seen"), batch.filter("first_seen").select("order_id")
    good, bad = arrivals.filter("reason IS NULL"), arrivals.filter("reason IS NOT NULL")

    # T1 + T3: the batch's events of new ids, earliest first (ids from the state store, or for a static batch J11)
    events = good.select(*EVENT_COLS)
    if new_ids is not None:
        new = dedupe_batch(events.join(new_ids, "order_id", "left_semi"))
    else:
        earlier = stored(spark, store, "orders", before=batch_id)
        new = dedupe_batch(events)
        new = new if earlier is None else new.join(earlier.select("order_id"), "order_id", "left_anti")
    _write(new.withColumn("batch_id", bid), os.path.join(store, "orders"))
    written = os.path.join(store, "orders", f"batch_id={batch_id}")
    new = spark.read.parquet(written) if path_exists(spark, written) else new.limit(0)      # a batch of duplicates writes no folder

    # S4 + T5
    _write(bad.select("line", *EVENT_COLS, "reason", bid.alias("batch_id")), os.path.join(store, "quarantine"))
    n_new = new.agg(F.count(F.lit(1))).scalar()
    audit = arrivals.agg(F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("errors"))
    _write(audit.select(bid.alias("batch_id"), n_new.alias("accepted"), (F.col("valid") - n_new).alias("duplicates"), "errors"),
           os.path.join(store, "audit"))

    # T2 + T4: the state of every customer seen (by a duplicate order too), from the buckets of these customers only
    seen = good.select("customer_id").distinct()
    delta = seen.join(profile_state(new), "customer_id", "left").select(
        "customer_id", bid.alias("first_batch"), F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"),
        F.col("value_sum").cast("decimal(38,6)").alias("value_sum"), "first_purchase", "last_purchase", "review_sum",
        F.coalesce("review_n", F.lit(0).cast("long")).alias("review_n"), F.lit(None).cast("boolean").alias("above"))
    touched = sorted(r.bucket for r in seen.select(bucket_of(buckets).alias("bucket")).distinct().collect())     # at most ``buckets`` numbers
    before = _manifest(spark, store, before=batch_id)
    old = _state_rows(spark, store, {b: before[b] for b in touched if b in before})
    merged = delta if old is None else merge_state(old, delta)

    # The side of the rule for the customers seen; who crosses it fires
    if scored is not None:
        mine = merged.join(seen, "customer_id", "left_semi")
        if callable(scored):
            scores = scored(profiles_from_state(mine, as_of_col)).withColumnRenamed("customer_id", "customer_unique_id")
        else:
            scores = scored.join(seen.withColumnRenamed("customer_id", "customer_unique_id"), "customer_unique_id", "left_semi")
        th = params or config
        limits = (getattr(th, "churn_threshold", config.ACTIVATION_CHURN_MIN), getattr(th, "clv_threshold", config.ACTIVATION_CLV_MIN))
        last = mine.select(F.col("customer_id").alias("customer_unique_id"), F.coalesce("above", F.lit(False)).alias("_last"))
        fired = scores.join(last, "customer_unique_id").filter(~F.col("_last"))
        _write(actions.activation_events(fired, as_of_col, *limits).withColumn("batch_id", bid), os.path.join(store, "activations"))
        sides = scores.select(F.col("customer_unique_id").alias("customer_id"), F.coalesce(actions.eligible(*limits), F.lit(False)).alias("_side"))
        merged = merged.join(sides, "customer_id", "left").withColumn("above", F.coalesce("_side", "above")).drop("_side")
    if touched:
        _put_state(spark, store, batch_id, merged, touched, before, buckets)


def intake_stream(lines: DataFrame) -> DataFrame:
    """The stream a batch is made of: every arrival, and one ``first_seen`` row for each order id not met before."""
    events = parse_lines(lines)
    ids = events.filter("reason IS NULL").select("order_id").dropDuplicates(["order_id"])
    blank = {f.name: f.dataType for f in events.schema.fields if f.name != "order_id"}
    ids = ids.select("order_id", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], F.lit(True).alias("first_seen"))
    return events.withColumn("first_seen", F.lit(False)).unionByName(ids)


def start_intake(spark: SparkSession, source_dir: str, store: str, checkpoint: str, as_of=None,
                 scored: DataFrame | Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True,
                 max_files: int | None = None, compact_every: int = 50, params=None, buckets: int = BUCKETS):
    """Stream JSON order events from ``source_dir`` into the store; ``params`` holds the activation thresholds."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or \
            "HDFSBackedStateStoreProvider" in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = intake_stream(reader.load(source_dir).select("value"))
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: process_batch(df, bid, store, as_of, scored, params, compact_every, buckets)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def current_state(spark: SparkSession, store: str) -> DataFrame:
    """One row per customer ever seen: first batch, order statistics, last side of the activation rule."""
    rows = _state_rows(spark, store, _manifest(spark, store))
    return spark.createDataFrame([], STATE_SCHEMA) if rows is None else rows


STATE_SCHEMA = ("customer_id string, first_batch long, n_orders long, value_sum decimal(38,6), first_purchase timestamp, "
                "last_purchase timestamp, review_sum double, review_n long, above boolean")


def current_profiles(spark: SparkSession, store: str, as_of=None) -> DataFrame:
    """The live customer table: the state of every customer with an order, as profiles at ``as_of``."""
    return profiles_from_state(current_state(spark, store), F.current_timestamp() if as_of is None else as_of)


def store_stats(spark: SparkSession, store: str) -> DataFrame:
    """A24 from the customer state: a sum over customers, no scan of the order history."""
    return current_state(spark, store).agg(
        F.count(F.lit(1)).alias("db_customers"), F.coalesce(F.sum("n_orders"), F.lit(0)).alias("db_orders"),
        round_half_even(F.coalesce(F.sum("value_sum").cast("double"), F.lit(0.0)), 2).alias("db_total_revenue"))


def live_stats(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers, orders and revenue in the live store (no orders -> 0)."""
    c = customers.agg(F.count_distinct("customer_id")).scalar()
    return orders.agg(F.count(F.lit(1)).alias("db_orders"),
                      F.coalesce(F.sum(money("total_value")).cast("double"), F.lit(0.0)).alias("_rev")
                      ).select(c.alias("db_customers"), "db_orders",
                               round_half_even("_rev", 2).alias("db_total_revenue"))


def intake_counts(feed: DataFrame) -> DataFrame:
    """T5 over a whole feed: accepted (distinct valid orders), duplicates, errors."""
    ok = valid_rows(feed)
    return feed.agg(F.count_distinct(F.when(ok, F.col("order_id"))).alias("accepted"),
                    (F.count_if(ok) - F.count_distinct(F.when(ok, F.col("order_id")))).alias("duplicates"),
                    F.count_if(~ok).alias("errors"))


def unprocessed_orders(feed: DataFrame, stored: DataFrame) -> DataFrame:
    """Orders of the feed not yet stored."""
    return feed.join(stored.select("order_id"), "order_id", "left_anti")
