"""Shared helpers of the training-data operators: reading, staging, chunked Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.session import cut_lineage

#: FIXED VALUE: the white space of all contracts, as a class of Java and RE2 patterns.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
#: Text bytes that a Python task handles at once.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write and reread ``df`` in the shared checkpoint folder (cuts the lineage, survives lost executors)."""
    return cut_lineage(df, f"llm-{name}")


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id belongs to no fold and gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return a Python task's freed memory to the system: a reused worker keeps its high-water mark otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc alone has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column of each piece holds about ``limit`` bytes (one row at least)."""
    limit = limit or CHUNK_BYTES
    give_back()                                            # what the worker's last task held: its broadcasts are gone only now
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)
        del batch, column, sizes
    give_back()


def arrow_job(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text"):
    """A ``mapInArrow`` function that applies ``fn`` to text-bounded slices."""
    def run(batches):
        for piece in slices(batches, text):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out
    return run
