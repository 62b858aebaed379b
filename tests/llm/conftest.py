import pytest
from pyspark.sql import types as T

LONG = "erlyating the of reinthat " * 8000
ROWS = [
    (0, "The of reinthat ingan and erhe the thing.", "en", "a", 41),
    (1, None, "en", "a", 0),
    (2, "", None, "b", 0),
    (3, " \t\n ", "fr", None, 4),
    (4, LONG, "en", "a", len(LONG)),
    (5, "The of reinthat ingan  and\nerhe the thing.", "en", "b", 42),
    (5, "The of reinthat ingan  and\nerhe the thing.", "en", "b", 42),
    (None, "Une leeux qui ément étre, la de éeau.", "fr", "c", 37),
    (7, "Une leeux qui ément étre, la de éeau.", "fr", "c", 37),
    (8, "12345 ... 67 !!", "de", "c", 15),
    (9, "Größe 😀 日本語 \x00 ende", "de", None, 18),
    (10, "one two", "en", "d", 7),
    (11, "one two", "en", "d", 7),
]
#: Columns that the operators use inside: extra columns of these names must not matter.
EXTRA = ["key", "sha", "node", "row", "size", "block", "bucket", "found_lang", "dedup_key", "near_hash", "score", "n",
         "row_number", "shard", "slot", "row_digest", "row_copies", "number_range", "range_rows", "place", "unfold_from", "doc", "number", "law",
         "cuts", "cuts_", "mix_hash", "mix_copy", "c_id", "c_source", "c_copy", "d_id", "copy", "digest", "range", "words", "kept_0"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in EXTRA)])


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([(*r, *(["x"] * len(EXTRA))) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
