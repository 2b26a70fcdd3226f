"""Suffix-array dedup by prefix-free parsing.

1. Rolling-hash triggers cut every document into phrases (`phrases.parse`).
2. The dictionary is aggregated by trigger. A trigger seen once holds no
   repeat; a trigger whose phrases are all the same text repeats as a whole.
3. For the other triggers the distinct phrases are fetched, one occurrence
   each, and the suffixes of at least `window` bytes of each trigger's part of
   the dictionary are put in suffix-array order and compared byte by byte.
   Overlaps of window - 1 bytes make shorter suffixes redundant, and equal
   windows share their trigger, so the order within triggers is all that the
   corpus order adds.
4. Dictionary and parse combine: a suffix class counts the occurrences of all
   phrases that hold it, and the parse carries the marks back to documents.

A trigger of very many distinct phrases, such as that of a passage which stands
in ever new surroundings, is dealt window by window instead, by 64 bits of the
window beside the trigger. So no task gets more than HOT_PHRASES phrases of one
trigger; whole texts move twice, as zstd frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernels as K
from weft.llm.frames import cut, mapped
from weft.llm.phrases import HOT_PHRASES, by_trigger, hot_marks, keyed, packed, parse, split_hot, unpack

ANCHOR_SHARE = 0.32  # of a window's bytes, for the trigger's slice


def repeated_suffixes(phrases: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each distinct phrase, which of its windows stand at two places of the corpus at least.

    Suffixes of equal rank in the suffix array of the phrases, cut at window
    bytes, form a class, whose size is the sum of the phrases' counts.
    """
    rank, n = K.window_ranks(phrases, window)
    total = np.bincount(rank, np.repeat(counts, n))
    return np.split(total[rank] >= 2, np.cumsum(n)[:-1])


def _pieces(m: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of whole triggers of about K.CHUNK_BYTES of phrases."""
    bounds = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1], [True]]))
    at = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + K.CHUNK_BYTES, "right")) - 1)
        yield int(bounds[i]), int(bounds[j])
        i = j


def duplicate_spans(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_PHRASES) -> DataFrame:
    """(did, dh, starts, ends): byte ranges of each row that lie in a `window`-byte string found at two places.

    Null texts count as empty, null ids as one smallest id; rows that repeat an
    id are places of their own. Ranges may overlap; rows without any are absent.
    Triggers of more than `hot` distinct phrases are dealt window by window.
    """
    rows = keyed(docs, id_col, text_col)
    runs = parse(rows, "byte", window, max(1, int(window * ANCHOR_SHARE)))
    triggers = runs.groupBy("m").agg(F.count(F.lit(1)).alias("seen"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("seen > 1")
    triggers = cut(triggers.select("m", (F.col("c0") == F.col("c1")).alias("alike")))  # a bare exchange on both sides lets a hot trigger be split
    found = cut(runs.join(triggers, "m"))
    mixed = found.where("not alike")
    phrases = mixed.groupBy("m", "c").agg(F.count(F.lit(1)).alias("seen"), F.min(F.struct("did", "dh", "a", "n")).alias("at"))
    wanted = cut(phrases.select("at.did", "at.dh", F.struct("at.a", "at.n", "m", "c", "seen").alias("phrase")))
    fetched = packed(rows.join(wanted.select("did", "dh").distinct(), ["did", "dh"], "left_semi")).dropDuplicates(["did", "dh"])
    per_doc = wanted.groupBy("did", "dh").agg(F.collect_list("phrase").alias("phrases"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, sizes, lists = batch.column("z"), batch.column("size").to_pylist(), batch.column("phrases")
            for i in range(batch.num_rows):
                text, items = unpack(z[i], sizes[i]), lists[i].values
                a, n = (np.asarray(items.field(f)) for f in ("a", "n"))
                body = [text[x : x + y + window - 1] for x, y in zip(a.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([items.field("m"), items.field("c"), items.field("seen"), pa.array(body, pa.binary())], names=["m", "c", "seen", "body"])

    dictionary = fetched.join(per_doc, ["did", "dh"]).select("z", "size", "phrases").transform(mapped, fetch, "m long, c long, seen long, body binary")
    dictionary, warm = split_hot(dictionary, wanted.select("phrase.m"), hot)

    def mark(table: pa.Table) -> pa.Table:
        m, c, seen = (table.column(i).to_numpy() for i in range(3))
        body = table.column(3).to_pylist()
        out_c, out_s, out_e, out_m = [], [], [], []
        for i, j in _pieces(m, [len(x) for x in body]):
            marks = repeated_suffixes(body[i:j], seen[i:j], window)
            for k, (s, e) in zip(range(i, j), map(K.runs_of, marks), strict=True):
                if len(s):
                    out_m.append(m[k])
                    out_c.append(c[k])
                    out_s.append(s.astype(np.int32))
                    out_e.append(e.astype(np.int32))
        return pa.table([pa.array(out_m, pa.int64()), pa.array(out_c, pa.int64()), pa.array(out_s, pa.list_(pa.int32())), pa.array(out_e, pa.list_(pa.int32()))], names=["m", "c", "s", "e"])

    marks = dictionary.repartition("m").sortWithinPartitions("m").transform(mapped, lambda it: by_trigger(it, "m", mark), "m long, c long, s array<int>, e array<int>")
    if warm is not None:
        warm = warm.select("m", "c", F.col("seen").cast("double").alias("weight"), F.lit(None).cast("binary").alias("flags"), F.lit(1.5).alias("least"), "body")
        marks = marks.unionByName(hot_marks(warm, window).withColumn("e", F.transform("s", lambda j: j + 1)))
    spans = found.where("alike").select("did", "dh", F.array("a").alias("s"), F.array(F.col("a") + F.col("n") + F.lit(window - 1)).alias("e"))
    spans = spans.unionByName(mixed.join(marks, ["m", "c"]).select("did", "dh", F.expr("transform(s, x -> x + a)").alias("s"), F.expr(f"transform(e, x -> x + a + {window - 1})").alias("e")))
    return spans.groupBy("did", "dh").agg(F.flatten(F.collect_list("s")).alias("starts"), F.flatten(F.collect_list("e")).alias("ends"))


def suffix_dedup(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_PHRASES) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts anywhere else in the corpus.

    Returns one row per input row: the id, n_bytes, kept (binary, the remaining
    bytes in order) and spans (maximal removed ranges of UTF-8 bytes). Null and
    empty texts give no bytes and no spans; an empty table gives no rows; other
    columns of docs are ignored, whatever their names.
    """
    spans = duplicate_spans(docs, window, id_col, text_col, hot)
    texts = packed(keyed(docs, id_col, text_col))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, sizes = batch.column("z"), batch.column("size").to_pylist()
            starts, ends = batch.column("starts"), batch.column("ends")
            kept, spans = [], []
            for i, size in enumerate(sizes):
                text = unpack(z[i], size)
                if starts[i].is_valid:
                    gone = K.cover(size, np.asarray(starts[i].values), np.asarray(ends[i].values))
                    s, e = (x.tolist() for x in K.runs_of(gone))
                    kept.append(b"".join(text[x:y] for x, y in zip([0, *e], [*s, size], strict=True)))
                    spans.append([{"start": x, "end": y} for x, y in zip(s, e, strict=True)])
                else:
                    kept.append(text)
                    spans.append([])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("size").cast(pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)], names=["did", "n_bytes", "kept", "spans"])

    joined = texts.join(spans, ["did", "dh"], "left").select("did", "size", "z", "starts", "ends")
    out = joined.transform(mapped, remove, "did long, n_bytes long, kept binary, spans array<struct<start:int,end:int>>")
    return out.select(F.nullif(F.col("did"), F.lit(-(2**63))).alias(id_col), "n_bytes", "kept", "spans")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """op1: 200-byte repeats of documents; digests of what is left."""
    from weft.llm.frames import table

    out = suffix_dedup(table(spark, sf_dir, "documents"), 200)
    gone = F.expr("aggregate(spans, 0L, (t, x) -> t + x.end - x.start)")
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
