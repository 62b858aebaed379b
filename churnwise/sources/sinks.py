"""Sinks: CSV exports (S8, S9) and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Header row; with ``quote_all`` every field is quoted, quotes
    doubled and null written as an empty quoted field."""
    w = df.write.mode("overwrite").option("header", True)
    if quote_all:
        w = w.option("quoteAll", True).option("escape", '"').option("nullValue", "").option("emptyValue", "")
    w.csv(path)


def read_csv_as(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame:
    """A file of :func:`write_csv` with the types of ``layout``; empty fields are null."""
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    return raw.select(*[F.nullif(F.col(f.name), F.lit("")).cast(f.dataType).alias(f.name) for f in layout.fields])


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def as_records(df: DataFrame) -> DataFrame:
    """S10 as a column: each row as a JSON string (for a serving layer)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))
