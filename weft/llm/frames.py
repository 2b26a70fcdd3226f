"""Helpers shared by the operators: row keys and table access."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.lineage import cut, shared_folder

__all__ = ["NULL_ID", "cut", "mapped", "release", "row_id", "shared_folder", "table", "text_key"]

#: Stands for a null identifier inside the operators; smaller than any other.
NULL_ID = -(2**63)
#: Bytes of the batches that workers get, about; a longer row stands alone. Spark's own bound lets batches of whole texts add up in JVM and workers.
BATCH_BYTES = 8 << 20


def row_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def text_key(name: str) -> Column:
    """Tells rows that repeat an identifier apart by their text."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # no glibc
        return None


def release() -> None:
    """Gives freed memory back to the system: workers are reused, and what they hold adds up beside the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(work, schema) in batches of BATCH_BYTES; the worker gives its memory back after each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)
