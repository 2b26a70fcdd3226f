"""Prefix-free parse of a corpus into trigger phrases, as Spark tables.

A *phrase* is a maximal run of consecutive fixed-length windows of one document
that share a trigger: the smallest rolling hash inside the window. Neighbouring
phrases overlap by window - 1 symbols, so each window lies in exactly one
phrase, and equal windows always lie in phrases of the same trigger. The
*parse* of a document is its sequence of phrases, the *dictionary* holds each
distinct phrase once. Work on repeats then needs the dictionary only, and of it
only the triggers that occur twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernels as K
from weft.llm.frames import cut, mapped, row_id, text_key

#: Distinct phrases of a trigger beyond which its windows are dealt one by one.
HOT_PHRASES = 512
SPLIT = 16  # parts of the windows of such a trigger
PARSE_SCHEMA = "did long, dh long, a int, n int, m long, c long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, dh, text): the row key used inside the operators, whatever other columns docs has."""
    return docs.select(row_id(id_col).alias("did"), text_key(text_col).alias("dh"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def symbols(data: np.ndarray, offsets: np.ndarray, unit: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol values, which depend on `reach` symbols more, and document offsets: bytes or words."""
    if unit == "byte":
        return (K.byte_grams(data) if reach else K.byte_values(data)), offsets
    starts, ends, first = K.word_bounds(data, offsets)
    words = K.word_hashes(data, starts, ends)
    return (K.word_grams(words) if reach else words), first


def reach_of(unit: str, anchor: int) -> int:
    """How far the values of symbols look ahead; not at all where anchors are too short for it."""
    reach = K.BYTE_REACH if unit == "byte" else K.WORD_REACH
    return reach if anchor > reach else 0


def parse(rows: DataFrame, unit: str, window: int, anchor: int) -> DataFrame:
    """The phrases of each row of keyed(): first window, number of windows, trigger and content hash."""
    reach = reach_of(unit, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, dh = (np.asarray(batch.column(i)) for i in (0, 1))
            data, offsets = K.text_buffer(batch.column(2))
            out = []
            for i, _, part, offs in K.document_chunks(data, offsets):
                values, at = symbols(part, offs, unit, reach)
                doc, a, n, m, c, _ = K.anchored_runs(values, at, window, anchor, reach)
                out.append((did[i + doc], dh[i + doc], a.astype(np.int32), n.astype(np.int32), m, c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["did", "dh", "a", "n", "m", "c"])

    return mapped(rows, run, PARSE_SCHEMA)


def packed(rows: DataFrame) -> DataFrame:
    """keyed() rows with the text as zstd frames, which halves what a shuffle of whole texts moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(2))
            view = memoryview(data)
            texts = [view[offsets[i] : offsets[i + 1]] for i in range(batch.num_rows)]
            z = pa.array([codec.compress(t, asbytes=True) if len(t) else b"" for t in texts], pa.binary())
            size = pa.array(np.diff(offsets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z, size], names=["did", "dh", "z", "size"])

    return mapped(rows, run, "did long, dh long, z binary, size int")


def unpack(z: pa.Scalar, size: int) -> bytes:
    return pa.decompress(z.as_buffer(), size, "zstd", asbytes=True) if size else b""


def split_hot(dictionary: DataFrame, triggers: DataFrame, most: int = HOT_PHRASES) -> tuple[DataFrame, DataFrame | None]:
    """The dictionary without and of the triggers that have more than `most` phrases (None where there are none); triggers: m once a phrase."""
    hot = cut(triggers.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("m"))
    if hot.isEmpty():
        return dictionary, None
    dictionary = cut(dictionary)
    return dictionary.join(hot, "m", "left_anti"), dictionary.join(hot, "m", "left_semi")


def hot_marks(dictionary: DataFrame, window: int) -> DataFrame:
    """(m, c, s): places of windows in a phrase whose weights, summed over the equal windows of the trigger, exceed `least`.

    dictionary: m, c, weight, flags (binary, a byte a window, 0 for one that does
    not count; null: all count), least, body. A trigger's windows are dealt by
    bits of their own hashes, packed by phrase, so that its phrases meet in many
    tasks, each with a part of the windows. A phrase may have several rows.
    """
    reach = K.BYTE_REACH if window > K.BYTE_REACH else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(5))
            for i, j, part, offs in K.document_chunks(data, offsets):
                rows = batch.slice(i, j - i)
                m, c, weight, least = (np.asarray(rows.column(x)) for x in ("m", "c", "weight", "least"))
                rolled = K.rolling_hashes(K.prefix_sums(K.byte_grams(part) if reach else K.byte_values(part)), window - reach)
                n = np.diff(offs) - window + 1
                ends = np.cumsum(n)
                owner, place = np.repeat(np.arange(j - i), n), np.arange(ends[-1]) - np.repeat(ends - n, n)
                w = rolled[offs[:-1][owner] + place].view(np.int64)
                x = weight[owner] * np.concatenate([np.frombuffer(f, np.uint8) if f else np.ones(k) for f, k in zip(rows.column("flags").to_pylist(), n.tolist(), strict=True)])
                bucket = w & (SPLIT - 1)
                order = np.lexsort((bucket, owner))
                owner, bucket = owner[order], bucket[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])]))
                lists = pa.array(np.append(first, len(order)).astype(np.int32))
                key = K.mix(m[owner[first]].view(np.uint64) + bucket[first].astype(np.uint64), K._MIX_C).view(np.int64)
                packed_ = (pa.ListArray.from_arrays(lists, pa.array(v)) for v in (place[order].astype(np.int32), w[order], x[order]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(m[owner[first]]), pa.array(c[owner[first]]), pa.array(least[owner[first]]), *packed_], names=["k", "m", "c", "least", "s", "w", "x"])

    def count(t: pa.Table) -> pa.Table | None:
        k = t.column("k").to_numpy()
        w, x = (t.column(f).combine_chunks().flatten().to_numpy() for f in ("w", "x"))
        s = t.column("s").combine_chunks()
        size = np.diff(np.asarray(s.offsets))
        row = np.repeat(np.arange(len(k)), size)
        group = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))[row]
        order = np.lexsort((w, group))
        new = np.concatenate([[True], (w[order][1:] != w[order][:-1]) | (group[order][1:] != group[order][:-1])])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        hit = np.bincount(of, x)[of] > t.column("least").to_numpy()[row]
        kept = np.bincount(row[hit], minlength=len(k))
        some = pa.array(kept > 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept[kept > 0])]).astype(np.int32)), pa.array(s.flatten().to_numpy()[hit]))
        return pa.table([t.column("m").filter(some), t.column("c").filter(some), lists], names=["m", "c", "s"])

    rows = dictionary.select("m", "c", "weight", "flags", "least", "body")
    dealt = mapped(rows, pack, "k long, m long, c long, least double, s array<int>, w array<long>, x array<double>")
    return mapped(dealt.repartition("k").sortWithinPartitions("k"), lambda it: by_trigger(it, "k", count), "m long, c long, s array<int>")


def by_trigger(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.Table], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """Apply work to tables that hold whole groups of `key`, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        if held and np.asarray(held[-1].column(key))[-1] != keys[0]:
            yield from _done(held, work)
            held = []
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield from _done([*held, batch.slice(0, cut)], work)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _done(held, work)


def _done(held: list[pa.RecordBatch], work: Callable[[pa.Table], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    out = work(pa.Table.from_batches(held))
    if out is not None:
        yield from out.combine_chunks().to_batches()
