"""Exact dedup by a log-structured merge index of text digests.

Each task is a store: rows enter a memtable, which is flushed as a run sorted
by digest, with a Bloom filter, once it is full; runs of a task are compacted
before they leave it, and a store that holds MOST_HELD entries hands over its
runs and begins anew. Shards by digest then merge the runs of all tasks, sorted
by Spark's external sort, in one pass that holds a batch at a time, keeping per
digest the identifier that stays and the number of rows. Rows whose
digest is hit by another row are verified byte by byte against the row that
stays, so an equal digest alone never drops a row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernels as K
from weft.llm.filters import may_match
from weft.llm.frames import NULL_ID, cut, mapped, row_id, table

#: Entries of a memtable and runs of a level; bound a store's unsorted part and its number of runs.
MEMTABLE_ROWS = 65_536
LEVEL_RUNS = 4
MOST_HELD = 1 << 20  # entries of a store's runs together
_FILTER_BITS = 16  # bits of a run's filter per entry


class Run:
    """A flushed memtable: digests in order, each with its identifier and count, behind a filter."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, smallest: bool):
        order = np.lexsort((ids, digests))
        digests, ids, counts = digests[order], ids[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], digests[1:] != digests[:-1]])) if len(digests) else np.zeros(0, np.int64)
        self.digests = digests[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        last = np.append(first[1:], len(digests)) - 1
        self.ids = ids[first if smallest else last]
        self.size = 1 << max(6, int(len(self.digests) * _FILTER_BITS).bit_length())

    @functools.cached_property
    def bits(self) -> np.ndarray:
        """The filter; a run that is never merged needs none."""
        out = np.zeros(self.size, bool)
        for place in self._places(self.digests):
            out[place] = True
        return out

    def _places(self, digests: np.ndarray) -> list[np.ndarray]:
        halves = np.frombuffer(digests.tobytes(), "<u8").reshape(len(digests), -1) if len(digests) else np.zeros((0, 2), np.uint64)
        return [(halves[:, k] % np.uint64(self.size)).astype(np.int64) for k in range(2)]

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.bits[p] for p in self._places(digests)])


class Store:
    """Memtable, runs and compaction of one task."""

    def __init__(self, smallest: bool):
        self.smallest, self.levels, self.memtable, self.rows = smallest, [[]], [], 0

    def put(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.memtable.append((digests, ids, counts))
        self.rows += len(digests)
        if self.rows >= MEMTABLE_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self._add(0, Run(*(np.concatenate(x) for x in zip(*self.memtable, strict=True)), self.smallest))
            self.memtable, self.rows = [], 0

    def _add(self, level: int, run: Run) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= LEVEL_RUNS:
            runs, self.levels[level] = self.levels[level], []
            self._add(level + 1, self.compact(runs))

    def compact(self, runs: list[Run]) -> Run:
        """Merge runs. Entries that no other run's filter may hold need no lookup and pass as they are."""
        if len(runs) == 1:
            return runs[0]
        shared = [np.logical_or.reduce([o.may_hold(r.digests) for o in runs if o is not r]) for r in runs]
        hit = Run(*(np.concatenate([getattr(r, f)[s] for r, s in zip(runs, shared, strict=True)]) for f in ("digests", "ids", "counts")), self.smallest)
        return Run(*(np.concatenate([getattr(hit, f), *(getattr(r, f)[~s] for r, s in zip(runs, shared, strict=True))]) for f in ("digests", "ids", "counts")), self.smallest)

    @property
    def held(self) -> int:
        return self.rows + sum(len(r.digests) for level in self.levels for r in level)

    def close(self) -> Run | None:
        self.flush()
        runs = [r for level in self.levels for r in level]
        return self.compact(runs) if runs else None


def exact_dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per input row: id, keep_id (the id that stays), group_size, kept and text_sha256.

    Texts are equal when their bytes are; null counts as empty; null ids count
    as the smallest id. Of rows that repeat the id that stays all count as kept.
    Other columns of docs are ignored; an empty table gives no rows.
    digest_bytes below 32 makes digests collide; verification still tells texts apart.
    """
    smallest = keep == "smallest"
    width = 16 if digest_bytes <= 16 else 32
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.unhex(F.sha2(text, 256))
    digest = F.rpad(F.substring(sha, 1, min(digest_bytes, 32)), width, F.lit(b"\0"))
    rows = docs.select(row_id(id_col).alias("did"), sha.alias("sha"), digest.alias("digest"), text.alias("text"))

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = K.text_buffer(batch.column(0))
        return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), f"S{width}"), np.asarray(batch.column(1)), np.asarray(batch.column(2))

    def table_of(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(digests), [None, pa.py_buffer(digests.tobytes())])
        return pa.RecordBatch.from_arrays([flat.cast(pa.binary()), pa.array(ids), pa.array(counts)], names=["digest", "did", "n"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Store(smallest)
        for batch in batches:
            held.put(*entries(batch))
            if held.held >= MOST_HELD:
                run, held = held.close(), Store(smallest)
                yield table_of(run.digests, run.ids, run.counts)
        run = held.close()
        if run is not None:
            yield table_of(run.digests, run.ids, run.counts)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From entries in order of their digests; only the last digest waits for the next batch."""
        last = None
        for batch in batches:
            if batch.num_rows:
                given = entries(batch)
                run = Run(*((np.concatenate(x) for x in zip(last, given, strict=True)) if last else given), smallest)
                yield table_of(run.digests[:-1], run.ids[:-1], run.counts[:-1])
                last = run.digests[-1:], run.ids[-1:], run.counts[-1:]
        if last:
            yield table_of(*last)

    schema = "digest binary, did long, n long"
    flushed = rows.select("digest", "did", F.lit(1).cast("long").alias("n")).transform(mapped, store, schema)
    index = flushed.repartition("digest").sortWithinPartitions("digest").transform(mapped, compact, schema)
    index = cut(index.withColumnsRenamed({"did": "keep", "n": "size"}))
    named = rows.select("did", "sha", "digest").join(index, "digest")
    alike = may_match(rows.select("digest", "sha", "did", "text"), index.where("size > 1").select("digest"), "digest")
    buckets = alike.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    strangers = cut(buckets.where("low != high").select("digest"))
    if not strangers.isEmpty():  # digests that stand for several texts: group these rows by their bytes
        pick = F.min if smallest else F.max
        own = alike.join(strangers, "digest").groupBy("digest", "sha", "text").agg(pick("did").alias("own_keep"), F.count(F.lit(1)).alias("own_size"))
        named = named.join(own.drop("text"), ["digest", "sha"], "left")
        named = named.select("did", "sha", F.coalesce("own_keep", "keep").alias("keep"), F.coalesce("own_size", "size").alias("size"))
    null = F.lit(NULL_ID)
    return named.select(
        F.nullif("did", null).alias(id_col), F.nullif("keep", null).alias("keep_id"), F.col("size").alias("group_size"), (F.col("did") == F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """op3: groups of byte-equal documents; the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), "largest")


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
