"""A broadcast filter of fixed size in front of joins that move whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.frames import mapped

#: Most 64-bit words of a filter (8 MB).
FILTER_WORDS = 1 << 20


def may_match(rows: DataFrame, hits: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` may be in hits, by a filter of at most FILTER_WORDS words; no hit is missed.

    Rows pass where they are read, so that only those that may match move in the
    join that follows. Beyond the filter's size more pass than match; the
    result of that join stays the same.
    """
    words = 1 << max(10, min(FILTER_WORDS, hits.count() // 4).bit_length() - 1)
    place = F.pmod(F.xxhash64(on), F.lit(words * 64))
    marked = hits.select(place.alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[np.asarray(marked.column("word"))] = np.asarray(marked.column("bits"))
    shared = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(0)).astype(np.uint64)
            hit = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit.astype(bool))) for c in batch.columns[1:]], names=batch.schema.names[1:])

    return rows.select(place.alias("p"), *rows.columns).transform(mapped, sift, rows.schema)
