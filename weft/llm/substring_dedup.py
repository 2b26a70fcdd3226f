"""Substring dedup: Rabin-Karp hashes of all token windows, counted in Spark.

Every window of `window` words has a Rabin-Karp hash. Windows are grouped into
phrases by their trigger, the smallest inner hash, so that a window's count can
exceed one only if its trigger's does. Triggers and whole phrases settle most
windows; the hashes of the rest, each distinct phrase once, are exploded and
aggregated to the smallest document that holds them. Marked windows merge into
maximal removal intervals per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernels as K
from weft.llm.frames import cut, mapped, table
from weft.llm.phrases import HOT_PHRASES, keyed, packed, parse, reach_of, split_hot, symbols, unpack


def repeated_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_PHRASES) -> DataFrame:
    """(did, dh, spans): word ranges [start, end) whose windows also start in a row of smaller id.

    A null id counts as the smallest of all. Ranges may overlap; rows without any are absent.
    Triggers of more than `hot` distinct phrases are dealt window by window.
    """
    rows = keyed(docs, id_col, text_col)
    anchor = max(1, window // 2)
    reach = reach_of("word", anchor)
    runs = parse(rows, "word", window, anchor)
    triggers = runs.groupBy("m").agg(F.min("did").alias("first"), F.max("did").alias("last"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    triggers = cut(triggers.where("first < last").select("m", "first", (F.col("c0") == F.col("c1")).alias("alike")))
    found = cut(runs.join(triggers, "m"))
    mixed = found.where("not alike")
    phrases = mixed.groupBy("m", "c").agg(F.min(F.struct("did", "dh", "a", "n")).alias("at"))  # the smallest id that holds it
    wanted = cut(phrases.select("at.did", "at.dh", F.struct("at.a", "at.n", "m", "c").alias("phrase")))
    fetched = packed(rows.join(wanted.select("did", "dh").distinct(), ["did", "dh"], "left_semi")).dropDuplicates(["did", "dh"])
    per_doc = wanted.groupBy("did", "dh").agg(F.collect_list("phrase").alias("phrases"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, z, sizes, lists = batch.column("did"), batch.column("z"), batch.column("size").to_pylist(), batch.column("phrases")
            for i in range(batch.num_rows):
                data = np.frombuffer(unpack(z[i], sizes[i]), np.uint8)
                words, _ = symbols(data, np.array([0, len(data)]), "word", reach)
                whole = K.rolling_hashes(K.prefix_sums(words), window - reach).view(np.int64)
                items = lists[i].values
                a, n = (np.asarray(items.field(f)).astype(np.int64) for f in ("a", "n"))
                at = np.concatenate([[0], np.cumsum(n)])
                flat = whole[np.repeat(a - at[:-1], n) + np.arange(at[-1])]
                w = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([items.field("m"), items.field("c"), pa.repeat(did[i], len(items)), w], names=["m", "c", "did", "w"])

    dictionary = fetched.join(per_doc, ["did", "dh"]).select("did", "z", "size", "phrases").transform(mapped, hashes, "m long, c long, did long, w array<long>")
    dictionary, warm = split_hot(dictionary, wanted.select("phrase.m"), hot)
    windows = dictionary.repartition("m").select("m", "c", "did", F.posexplode("w").alias("j", "w"))
    counted = windows.groupBy("m", "w").agg(F.min("did").alias("first"), F.collect_list(F.struct("c", "j")).alias("places"))
    marks = counted.select("m", "first", F.explode("places").alias("p")).groupBy("m", "p.c").agg(F.collect_list(F.struct("p.j", "first")).alias("windows"))
    if warm is not None:  # no row gathers the places of a window here
        warm = warm.select("m", "c", "did", F.posexplode("w").alias("j", "w"))
        first = warm.groupBy("m", "w").agg(F.min("did").alias("first"))
        marks = marks.unionByName(warm.select("m", "c", "j", "w").join(first, ["m", "w"]).groupBy("m", "c").agg(F.collect_list(F.struct("j", "first")).alias("windows")))
    spans = found.where("alike and did > first").select("did", "dh", F.array(F.struct(F.col("a").alias("start"), (F.col("a") + F.col("n") + F.lit(window - 1)).alias("end"))).alias("spans"))
    partly = mixed.select("did", "dh", "a", "m", "c").join(marks, ["m", "c"])
    partly = partly.select("did", "dh", F.expr(f"transform(filter(windows, x -> x.first < did), x -> struct(a + x.j as start, a + x.j + {window} as end))").alias("spans"))
    return spans.unionByName(partly.where("size(spans) > 0")).groupBy("did", "dh").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_PHRASES) -> DataFrame:
    """Remove every word covered by a `window`-word sequence that also starts in a row of smaller id.

    Returns one row per input row: the id, n_words, kept (the remaining words
    joined by one space) and spans (maximal removed word ranges). Null and empty
    texts have no words; rows that share an id do not remove each other; other
    columns of docs are ignored; an empty table gives no rows.
    """
    spans = repeated_windows(docs, window, id_col, text_col, hot)
    texts = packed(keyed(docs, id_col, text_col))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, sizes, lists = batch.column("z"), batch.column("size").to_pylist(), batch.column("spans")
            counts, kept, spans = [], [], []
            for i, size in enumerate(sizes):
                text = unpack(z[i], size)
                words = text.translate(_TO_SPACE).split(b" ") if size else []
                words = [w for w in words if w]
                counts.append(len(words))
                if lists[i].is_valid:
                    items = lists[i].values
                    gone = K.cover(len(words), np.asarray(items.field("start")), np.asarray(items.field("end")))
                    s, e = (x.tolist() for x in K.runs_of(gone))
                    words = [w for x, y in zip([0, *e], [*s, len(words)], strict=True) for w in words[x:y]]
                    spans.append([{"start": x, "end": y} for x, y in zip(s, e, strict=True)])
                else:
                    spans.append([])
                kept.append(b" ".join(words))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)], names=["did", "n_words", "kept", "spans"])

    joined = texts.join(spans, ["did", "dh"], "left").select("did", "size", "z", "spans")
    out = joined.transform(mapped, remove, "did long, n_words long, kept string, spans array<struct<start:int,end:int>>")
    return out.select(F.nullif(F.col("did"), F.lit(-(2**63))).alias(id_col), "n_words", "kept", "spans")


_TO_SPACE = bytes(0x20 if K._SPACE[i] else i for i in range(256))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """op2: 50-word repeats of documents; digests of what is left."""
    out = substring_dedup(table(spark, sf_dir, "documents"), 50)
    gone = F.expr("aggregate(spans, 0L, (t, x) -> t + x.end - x.start)")
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
