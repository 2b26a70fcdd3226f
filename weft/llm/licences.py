"""License scans by diagonal voting.

Rolling hashes of all word k-grams are joined in Spark with their positions in
license templates. Hits of a document are aggregated by template and diagonal
(place in the document minus place in the template); neighbouring diagonals
merge into one vote, and the span it covers is verified word by word against
the template by the longest common subsequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import kernels as K
from weft.llm.frames import cut, mapped, table
from weft.llm.licence_texts import NOTICES, WHOLE
from weft.llm.phrases import keyed, packed, unpack

GRAM = 4
NEAR_DIAGONALS = 3  # words inserted or left out between hits of one vote
LEAST_SHARE = 0.6  # of a template's words, to label a document

#: Phrases whose places count as such, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = NOTICES + WHOLE


def _words(text: bytes) -> tuple[list[bytes], np.ndarray]:
    data = K.lower_ascii(np.frombuffer(text, np.uint8))
    starts, ends, _ = K.word_bounds(data, np.array([0, len(data)]), plain=True)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], K.word_hashes(data, starts, ends)


def _template_grams(spark: SparkSession, gram: int) -> DataFrame:
    rows = []
    for t, (_, text) in enumerate(TEMPLATES):
        words, hashes = _words(text.encode())
        grams = K.rolling_hashes(K.prefix_sums(hashes), gram).view(np.int64)
        rows.extend((int(g), t, i) for i, g in enumerate(grams.tolist()))
    return spark.createDataFrame(rows, "gram long, template int, place int")


def _weight(span: dict) -> tuple[bool, int, float]:
    return span["share"] >= LEAST_SHARE, span["words"], span["share"]


def unbeaten(spans: list[dict]) -> list[dict]:
    """The spans, in order, that no overlapping one explains better: by enough of its template, then by more words."""
    spans = sorted(spans, key=lambda s: (s["start"], s["end"]))
    beaten = [False] * len(spans)
    open_: list[int] = []  # spans that have begun and not ended; at most as many as templates and votes at one place
    for i, s in enumerate(spans):
        open_ = [j for j in open_ if spans[j]["end"] > s["start"]]
        for j in open_:
            if _weight(spans[j]) > _weight(s):
                beaten[i] = True
            elif _weight(spans[j]) < _weight(s):
                beaten[j] = True
        open_.append(i)
    return [s for s, gone in zip(spans, beaten, strict=True) if not gone]


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def scan(docs: DataFrame, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, places (of the base phrases: word, label) and spans (start, end, label, share).

    Null and empty texts have no words, places or spans. Repeated rows and null
    ids are rows of their own; other columns are ignored; an empty table gives no
    rows. Texts are read whole; in a long one, each vote is verified on the words
    around it alone, and spans are compared with those that they overlap.
    """
    rows = keyed(docs, id_col, text_col)
    spark = docs.sparkSession

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(2))
            for i, j, part, offs in K.document_chunks(data, offsets):
                part = K.lower_ascii(part)
                begin, end, first = K.word_bounds(part, offs, plain=True)
                rolled = K.rolling_hashes(K.prefix_sums(K.word_hashes(part, begin, end)), gram).view(np.int64)
                n = np.maximum(np.diff(first) - gram + 1, 0)  # none crosses a document's end
                ends = np.concatenate([[0], np.cumsum(n)])
                own = rolled[np.repeat(first[:-1] - ends[:-1], n) + np.arange(ends[-1])]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["did", "dh", "grams"])

    rolled = rows.transform(mapped, grams, "did long, dh long, grams array<long>").select("did", "dh", F.posexplode("grams").alias("pos", "gram"))
    hits = rolled.join(F.broadcast(_template_grams(spark, gram)), "gram")  # the templates are a constant
    votes = hits.groupBy("did", "dh", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    along = Window.partitionBy("did", "dh", "template").orderBy("lo", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > NEAR_DIAGONALS) | (F.col("lo") - F.lag("hi").over(along) > 2 * NEAR_DIAGONALS + gram)
    merged = votes.withColumn("vote", F.sum(F.when(apart, 1).otherwise(0)).over(along))
    merged = merged.groupBy("did", "dh", "template", "vote").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("from"), F.max("diagonal").alias("to"))
    per_doc = cut(merged.groupBy("did", "dh").agg(F.collect_list(F.struct("template", "lo", "hi", "from", "to")).alias("votes")))
    known = [_words(t.encode())[0] for _, t in TEMPLATES]
    labels = [name for name, _ in TEMPLATES]
    phrases = [(_words(p.encode()), label) for p, label in PHRASES.items()]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_type = pa.list_(pa.struct([("word", pa.int32()), ("label", pa.string())]))
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            z, sizes, lists = batch.column("z"), batch.column("size").to_pylist(), batch.column("votes").to_pylist()
            counts, places, spans = [], [], []
            for i, size in enumerate(sizes):
                data = K.lower_ascii(np.frombuffer(unpack(z[i], size), np.uint8))
                starts, ends, _ = K.word_bounds(data, np.array([0, size]), plain=True)
                hashes = K.word_hashes(data, starts, ends)
                own = []
                for (_, wanted), label in phrases:
                    n = len(hashes) - len(wanted) + 1
                    if n > 0:
                        hit = np.logical_and.reduce([hashes[k : n + k] == w for k, w in enumerate(wanted)])
                        own.extend({"word": int(p), "label": label} for p in np.flatnonzero(hit))
                found = []
                if lists[i]:
                    raw = data.tobytes()
                    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    for v in lists[i]:
                        template = known[v["template"]]
                        lo = max(0, min(v["lo"], v["from"] - NEAR_DIAGONALS))
                        hi = min(len(words), max(v["hi"] + gram, v["to"] + len(template) + NEAR_DIAGONALS))
                        agreed = common_words(words[lo:hi], template)
                        found.append({"words": agreed, "start": max(0, min(v["lo"], v["from"])), "end": min(len(words), max(v["hi"] + gram, v["to"] + len(template))), "label": labels[v["template"]], "share": agreed / len(template)})
                counts.append(len(starts))
                places.append(own)
                spans.append([{k: x for k, x in s.items() if k != "words"} for s in unbeaten(found)])
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(counts, pa.int64()), pa.array(places, place_type), pa.array(spans, span_type)], names=["did", "n_words", "places", "spans"])

    joined = packed(rows).join(per_doc, ["did", "dh"], "left").select("did", "z", "size", "votes")
    out = joined.transform(mapped, verify, "did long, n_words long, places array<struct<word:int,label:string>>, spans array<struct<start:int,end:int,label:string,share:double>>")
    return out.withColumn("did", F.nullif("did", F.lit(-(2**63)))).withColumnRenamed("did", id_col)


def op8_licences(spark, sf_dir: str) -> DataFrame:
    """op8: license phrases and verified template spans of all documents."""
    out = scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    sure = F.filter("spans", lambda s: s.share >= LEAST_SHARE)
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").cast("long").alias("first_word"), F.array_max("places.word").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.transform(sure, lambda s: s.label))), ",").alias("labels"), score.alias("score"),
    )
