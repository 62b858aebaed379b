"""Restartable runs (R6): a folder of finished stages, each under the key of what it was made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.operators import boosting
from churnwise.operators.boosting import BoostedTrees
from churnwise.session import path_exists


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order: one aggregate, no row leaves the executors."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n, low, high = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(20,0)")), F.bit_xor(row)).first()
    return hashlib.sha256(json.dumps([df.schema.json(), n, str(low), high]).encode()).hexdigest()


class Run:
    """Stages of one run.  A stage that was finished with the same inputs, parameters and run time is read, not made again.

    A stage's tables and models are written first and its manifest last, so a
    stage that broke off has no manifest and is made again.  Without ``out_dir``
    nothing is stored and every stage is made.
    """

    def __init__(self, spark: SparkSession, feat: DataFrame, as_of, params, out_dir: str | None):
        self.spark, self.base, self.made = spark, None, []
        if out_dir:
            at = None if as_of is None else spark.range(1).select(as_of.cast("string")).first()[0]
            key = hashlib.sha256(f"{fingerprint(feat)} {params!r} {at}".encode()).hexdigest()[:20]
            self.base = f"{out_dir.rstrip('/')}/run/{key}"

    def stage(self, name: str, make: Callable[[], dict]) -> dict:
        """``make()``'s tables and models, or those stored by an earlier call with this run's key."""
        if self.base is None:
            self.made.append(name)
            return make()
        at = f"{self.base}/{name}"
        if not path_exists(self.spark, f"{at}/manifest/_SUCCESS"):
            self.made.append(name)
            found = make()
            kinds = {k: "model" if isinstance(v, BoostedTrees) else "table" for k, v in found.items()}
            for k, v in found.items():
                if kinds[k] == "model":
                    v.save(self.spark, f"{at}/{k}")
                else:
                    v.write.mode("overwrite").parquet(f"{at}/{k}")
            self.spark.createDataFrame([(json.dumps(kinds),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest")
        kinds = json.loads(self.spark.read.parquet(f"{at}/manifest").first()["manifest"])
        return {k: boosting.load(self.spark, f"{at}/{k}") if kind == "model" else self.spark.read.parquet(f"{at}/{k}")
                for k, kind in kinds.items()}

    def forget(self) -> None:
        """Delete this run's stages (its results are stored elsewhere)."""
        if self.base is not None:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
