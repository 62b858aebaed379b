"""Token counts: rollups by source, language and tokenizer version, kept up to date by deltas.

A batch of changes is a frame of signed rows (source, lang, version, docs,
tokens): +1 document and its tokens for an insert, -1 and minus its tokens for
a delete, the old count negative and the new one positive for a revision.
``commit`` folds a batch to one delta per key (map-side combined, so a hot
source is a few rows when it is shuffled) and writes it as a table of its own,
named by the batch id.  A batch that is already committed is left as it is, so
a repeated delivery changes nothing.  Totals are sums over committed deltas;
``compact`` folds many batches to one base table, whose folder also lists the
ids of the batches in it and counts only once its last file is there: a job
that stops half way changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.llm.common import NOT_WS, read, stage, text_or_empty
from churnwise.session import ensure_checkpoint_dir

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, docs long, tokens long"


class Rollup:
    """Delta tables under ``folder`` (any store that Spark writes): one folder per batch, complete when it has _SUCCESS."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, sub: str) -> list[str]:
        at = self._path(f"{self.folder}/{sub}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _complete(self, sub: str, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{sub}/{name}/_SUCCESS"))

    def _base(self) -> tuple[list[str], set[str]]:
        """Path of the newest finished base table, if there is one, and the ids of the batches in it."""
        done = [n for n in self._names("base") if self._fs.exists(self._path(f"{self.folder}/base/{n}/DONE"))]
        if not done:
            return [], set()
        at = f"{self.folder}/base/{done[-1]}"
        return [f"{at}/totals"], {r["id"] for r in self.spark.read.parquet(f"{at}/ids").collect()}

    def _state(self) -> tuple[list[str], list[str], set[str]]:
        """Base path, complete batches beside it, and the ids in the base: one listing for whoever sums them."""
        base, folded = self._base()
        return base, [n for n in self._names("batches") if n not in folded and self._complete("batches", n)], folded

    def committed(self) -> list[str]:
        """Ids of all committed batches, compacted ones included."""
        _, batches, folded = self._state()
        return sorted(folded | set(batches))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Fold and write a batch; False if the batch was committed before (then nothing is read or written)."""
        if batch_id in self.committed():
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        # a job that died left an unfinished folder without _SUCCESS: overwritten
        delta.write.mode("overwrite").parquet(f"{self.folder}/batches/{batch_id}")
        return True

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def deltas(self) -> DataFrame:
        base, batches, _ = self._state()
        return self._read(base + [f"{self.folder}/batches/{n}" for n in batches])

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens); keys whose documents are all gone are left out."""
        return _summed(self.deltas())

    def compact(self) -> None:
        """Fold the base and all committed batches into a new base table; the ids go with it, so repeats are still refused."""
        base, batches, folded = self._state()
        at = f"{self.folder}/base/{len(self._names('base')):08d}"
        _summed(self._read(base + [f"{self.folder}/batches/{n}" for n in batches])).write.mode("overwrite").parquet(f"{at}/totals")
        ids = [(n,) for n in sorted(folded | set(batches))]
        self.spark.createDataFrame(ids, "id string").coalesce(1).write.mode("overwrite").parquet(f"{at}/ids")
        self._fs.create(self._path(f"{at}/DONE"), True).close()      # from here on the new base counts, and its batches no longer


def _summed(deltas: DataFrame) -> DataFrame:
    return (deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0"))


def inserts(rows: DataFrame, tokens: Column) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


def deletes(rows: DataFrame, tokens: Column) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-tokens).cast("long").alias("tokens"))


def revisions(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    return deletes(rows, old).unionAll(inserts(rows, new))


#: Tokenizer versions of the query: white-space words; words and single punctuation marks.
VERSIONS = {"words-1": f"{NOT_WS}+", "marks-1": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"}
#: Documents of fewer words are withdrawn by a late batch and brought back by the last one.
SHORT_WORDS = 5


def counts(docs: DataFrame) -> DataFrame:
    """(source, lang, chars, words, marks) per row; null texts count as empty."""
    t = text_or_empty()
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       F.length(t).cast("long").alias("chars"),
                       F.regexp_count(t, F.lit(VERSIONS["words-1"])).cast("long").alias("words"),
                       F.regexp_count(t, F.lit(VERSIONS["marks-1"])).cast("long").alias("marks"))


def document_batches(docs: DataFrame) -> list[tuple[str, DataFrame]]:
    """The documents' change feed: provisional counts, their revision, a second tokenizer, short documents withdrawn and brought back."""
    c = stage(counts(docs), "token-counts")
    one, two = c.withColumn("version", F.lit("words-1")), c.withColumn("version", F.lit("marks-1"))
    rough = F.ceil(F.col("chars") / 6).cast("long")
    short = F.col("words") < SHORT_WORDS
    return [("0001-load", inserts(one, rough)),
            ("0002-revise", revisions(one, rough, F.col("words"))),
            ("0003-marks", inserts(two, F.col("marks"))),
            ("0004-withdraw", deletes(one.filter(short), F.col("words")).unionAll(deletes(two.filter(short), F.col("marks")))),
            ("0005-return", inserts(one.filter(short), F.col("words")).unionAll(inserts(two.filter(short), F.col("marks"))))]


def token_counts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Totals over every document after the documents' batches, each delivered twice: source, lang, version, docs, tokens.

    Null and empty texts count as documents without tokens.  Null sources and
    languages are keys of their own; repeated rows count each; very long
    texts count whole; an empty table gives no row.  Columns other than text,
    source and lang are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollups/{uuid.uuid4().hex}"
    roll = Rollup(spark, folder)
    batches = document_batches(docs)
    for batch_id, changes in [*batches, *batches]:
        roll.commit(batch_id, changes)
    return roll.totals()


ORACLE = r"""
WITH c AS (SELECT source, lang,
  length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS words,
  length(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[!-/:-@\[-`{-~]', chr(1), 'g'),
    '[A-Za-z0-9\x{80}-\x{10FFFF}]+', chr(2), 'g'), '[^' || chr(1) || chr(2) || ']+', '', 'g')) AS marks FROM documents)
SELECT source, lang, 'words-1' AS version, count(*) AS docs, sum(words)::BIGINT AS tokens FROM c GROUP BY source, lang
UNION ALL
SELECT source, lang, 'marks-1' AS version, count(*) AS docs, sum(marks)::BIGINT AS tokens FROM c GROUP BY source, lang
"""
