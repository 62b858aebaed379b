"""Session construction and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "churnwise",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with the settings the plans rely on.

    UTC session zone (day arithmetic on timestamps), AQE with partition
    coalescing and skew-join splitting, no UI server.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is.  Only a local-mode session without that setting (tests, a laptop)
    gets a private folder, because a machine-local folder is not reachable
    by other executors on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    d = tempfile.mkdtemp(prefix="churnwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in its own store (local, HDFS, object store), asked through Hadoop's file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete the stage tables that this session's :func:`cut_lineage` wrote (call when a run's results are stored)."""
    while _STAGES:
        app, path = _STAGES.pop()
        if app == spark.sparkContext.applicationId:
            _delete(spark, path)


def drop_stage(df: DataFrame) -> None:
    """Delete one stage table, as :func:`cut_lineage` returned it, once nothing reads it any more."""
    entry = _TABLES.pop(df, None)
    if entry in _STAGES:
        _STAGES.remove(entry)
        _delete(df.sparkSession, entry[1])


#: (application id, path) of the stage tables written so far; the entry of each DataFrame handed out.
_STAGES: list[tuple[str, str]] = []
_TABLES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

#: Setting by which a finished execution deletes its shuffle files.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES = {"now": 0, "before": None}
_LOCK = threading.Lock()


@contextmanager
def _shuffles_go(spark: SparkSession):
    """While stage tables are written, an execution's shuffle files go with it; the setting returns after the last of them."""
    with _LOCK:
        if not _WRITES["now"]:
            _WRITES["before"] = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _WRITES["now"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITES["now"] -= 1
            if not _WRITES["now"]:
                if _WRITES["before"] is None:
                    spark.conf.unset(SHUFFLE_CLEANUP)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP, _WRITES["before"])


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder that :func:`drop_stages` deletes with the stage tables."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"
    _STAGES.append((spark.sparkContext.applicationId, path))
    return path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    The written table cuts the lineage like ``checkpoint()`` (a lost executor
    re-reads files instead of replaying joins), and unlike a serialized-row
    checkpoint every later read prunes columns, pushes filters into the scan
    and gives AQE real file sizes.  The shuffle files behind a written table
    are deleted at once.  Used at stage boundaries and before iterative ML.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/stages/{name}-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.mode("overwrite").parquet(path)
    entry = (spark.sparkContext.applicationId, path)
    _STAGES.append(entry)
    out = spark.read.parquet(path)
    _TABLES[out] = entry
    return out


def cut_parts(parts: Iterable[DataFrame], name: str = "stage") -> DataFrame:
    """Write DataFrames of one schema one after another as one stage table; the shuffle files of one go before the next begins."""
    path, spark = None, None
    for df in parts:
        spark = df.sparkSession
        if path is None:
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"
            entry = (spark.sparkContext.applicationId, path)
            _STAGES.append(entry)
        with _shuffles_go(spark):
            df.write.mode("append").parquet(path)
    out = spark.read.parquet(path)
    _TABLES[out] = entry
    return out
