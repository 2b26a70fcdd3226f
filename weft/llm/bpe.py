"""BPE encoding and decoding with a distinct-word table.

Spark splits each text before every run of white space that follows another
character; byte-level BPE never merges across such a place, whatever stands on
either side. A block is about a million words of some documents: its distinct
words, and the place of every word among them. The distinct
words of all blocks are dealt into buckets by their hash, each bucket encodes a
word the first time it meets it, and the ids go back to the block and the place
that they came from, where they are joined by position. Texts are cut into blocks
twice, for the words and for their places, which moves less than to store them;
input that comes from a shuffle, whose rows a lost executor may bring in another
order, is written as a table first. A block's key covers its words, so that input
that still differs between the two reads ends in an error and not in other ids.
Decoding joins every id with the id-to-piece table, which is as small as the
vocabulary and at every worker, by position, and concatenates the pieces.

No row holds more than a block, and no bucket more words at once than
_WORDS_HELD, whatever words are frequent: a word comes once a block.
"""

from __future__ import annotations

import functools
import json
import os
from array import array
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.llm.frames import cut, mapped, table

#: Before ASCII white space that follows a character which no definition counts as white space.
BOUNDARY = r"(?<=[^\s\x1C-\x1F\x85\p{Z}\p{Cf}])(?=[\x20\x09-\x0D])"
_WORDS_AT_ONCE = 1 << 20
_WORDS_PLACED = 1 << 17  # put into documents, or decoded, at once
_WORDS_ENCODED = 1 << 12  # at once: an encoding takes far more room than its ids
_WORDS_HELD = 1 << 18  # a bucket of more distinct words forgets and encodes again
_BUCKET_BYTES = 32 << 20  # of text, for one bucket of words


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own would each keep memory
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """Bytes of each id: the characters of byte-level vocabularies stand for bytes in a fixed order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as file:  # the vocabulary alone: a tokenizer keeps far more
        given = json.load(file)
    vocabulary = given["model"]["vocab"] | {t["content"]: t["id"] for t in given["added_tokens"]}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return pa.array(out, pa.large_binary())


def _word_lists(column: pa.Array, limit: int = _WORDS_AT_ONCE) -> Iterator[pa.Array]:
    """Slices of a list column of about limit words; a longer list stands alone."""
    offsets = np.asarray(column.offsets)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield column.slice(i, j - i)
        i = j


def _press(values: np.ndarray | bytes) -> bytes:
    """Length and zstd frame of bytes, or of 32-bit integers with their low bytes first, then the next, and so on."""
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", 5).compress(raw, asbytes=True) if raw else b"")


def _loosen(z: bytes) -> bytes:
    size = int.from_bytes(z[:8], "little")
    return pa.decompress(z[8:], size, "zstd", asbytes=True) if size else b""


def _integers(z: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_loosen(z), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _words(sizes: bytes, data: bytes) -> list[bytes]:
    raw, ends = _loosen(data), np.cumsum(_integers(sizes), dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _gathered(batches: Iterator[pa.RecordBatch], limit: int = _WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches together until they hold limit words."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(1).flatten())
        if n >= limit:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its documents, the code of every word in order, and its distinct words by code."""
    for batch in _gathered(batches):
        at = 0
        for lists in _word_lists(batch.column(1)):
            offsets = np.asarray(lists.offsets).astype(np.int64)
            coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            words = coded.dictionary.cast(pa.large_binary())
            ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
            data = words.buffers()[2]
            whole = pa.array([0, len(lists)], pa.int32())
            dids = pa.ListArray.from_arrays(whole, batch.column(0).slice(at, len(lists)))
            counts = pa.ListArray.from_arrays(whole, pa.array(np.diff(offsets).astype(np.int32)))
            own = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None and ends[-1] > ends[0] else b""
            key = blake2b(f"{batch.column(2)[at]} {crc32(own)}".encode(), digest_size=8).digest()
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(key, "little", signed=True)]), dids, counts, *(pa.array([_press(x)], pa.binary()) for x in (np.asarray(coded.indices), np.diff(ends), own))],
                names=["block", "dids", "counts", "codes", "sizes", "data"],
            )
            at += len(lists)
        pa.default_memory_pool().release_unused()


def _deal(blocks: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block, one row per bucket of their hash."""
    for batch in blocks:
        for row in batch.select(["block", "sizes", "data"]).to_pylist():
            words = _words(row["sizes"], row["data"])
            bucket = np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets)).tolist()
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                own = [words[i] for i in order[a:b].tolist()]
                out.append((int(bucket[order[a]]), _press(np.diff(order[a:b], prepend=0)), _press(np.fromiter(map(len, own), np.int64, b - a)), _press(b"".join(own))))
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array([row["block"]] * len(out), pa.int64()), *columns[1:]], names=["bucket", "block", "codes", "sizes", "data"])


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Blocks cut and dealt in one worker a task."""
    return rows.transform(mapped, lambda it: _deal(_cut_blocks(it), buckets), "bucket int, block long, codes binary, sizes binary, data binary")


def _placed(rows: DataFrame, kind: str) -> DataFrame:
    """The documents of each block, their ids of the given type, and the places of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _cut_blocks(batches):
            yield block.select(["block", "codes", "dids", "counts"])

    return rows.transform(mapped, run, f"block long, codes binary, dids array<{kind}>, counts array<int>")


def _coded(dealt: DataFrame, buckets: int, tokenizer_path: str) -> DataFrame:
    """The ids of the words of each row, every distinct word of a bucket encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                words = _words(row["sizes"], row["data"])
                new = [w for w in words if w not in known]
                if len(known) + len(new) > _WORDS_HELD:
                    known.clear()
                    new = words
                for k in range(0, len(new), _WORDS_ENCODED):
                    part = new[k : k + _WORDS_ENCODED]
                    made = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
                    known.update((w, array("i", e.ids).tobytes()) for w, e in zip(part, made, strict=True))
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                packed = [row["codes"], _press(sizes), _press(np.frombuffer(b"".join(ids), np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "codes", "sizes", "data"])

    return dealt.repartition(buckets, "bucket").select("block", "codes", "sizes", "data").transform(mapped, run, "block long, codes binary, sizes binary, data binary")


def _assembled(row: dict, tables: list[dict], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The documents of a block, with the ids of their words in place, some documents at a time."""
    codes = [np.cumsum(_integers(t["codes"]), dtype=np.int32) for t in tables]  # kept as steps
    sizes = [_integers(t["sizes"]) for t in tables]
    flat = np.concatenate([np.zeros(0, np.int32), *(_integers(t["data"]) for t in tables)])
    tables.clear()
    where, each = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (codes, sizes))
    size, start = np.zeros(len(where), np.int32), np.zeros(len(where), np.int64)
    size[where] = each
    start[where] = np.cumsum(each, dtype=np.int64) - each
    code = _integers(row["codes"])
    if len(where) != int(code.max(initial=-1)) + 1:
        raise ValueError("the documents differ between two reads; write them as a table first")
    dids = pa.array(row["dids"], kind)
    first = np.concatenate([[0], np.cumsum(row["counts"], dtype=np.int64)])
    i = 0
    while i < len(dids):
        j = max(i + 1, int(np.searchsorted(first, first[i] + _WORDS_PLACED, "right")) - 1)
        part = code[first[i] : first[j]]
        n = size[part]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = flat[np.repeat(start[part] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[first[i : j + 1] - first[i]]
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([dids.slice(i, j - i), pa.array(np.diff(bounds)), lists], names=["did", "n_tokens", "ids"])
        i = j


def _settled(docs: DataFrame) -> DataFrame:
    """docs, as a table if they come out of a shuffle or a cache and may come in another order when read again."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return cut(docs) if "Exchange" in plan or "InMemoryTableScan" in plan else docs


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens and ids (array), as the whole text's encoding without added special tokens.

    Null and empty texts have no ids; repeated rows and null ids are kept as
    they are; other columns of docs are ignored; an empty table gives no rows. An
    id that is a struct keeps its type, so that more of a row can travel with it.
    """
    given = docs.schema[id_col].dataType
    kind = given.simpleString() if isinstance(given, StructType) else "bigint"
    docs = _settled(docs.select(F.col(id_col).cast(kind).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    words = F.split("text", BOUNDARY, -1)
    rows = docs.select("did", words.alias("words"), F.monotonically_increasing_id().alias("row"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // _BUCKET_BYTES)
    coded = _coded(_dealt(rows, buckets), buckets, tokenizer_path).withColumns({"kind": F.lit(0), "dids": F.lit(None).cast(f"array<{kind}>"), "counts": F.lit(None).cast("array<int>")})
    placed = _placed(rows, kind).withColumns({"kind": F.lit(1), "sizes": F.lit(None).cast("binary"), "data": F.lit(None).cast("binary")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    tables.append(row)
                else:  # the block's last row
                    yield from _assembled(row, tables, batch.schema.field("dids").type.value_type)
                    pa.default_memory_pool().release_unused()

    both = coded.unionByName(placed).repartition(buckets, "block").sortWithinPartitions("block", "kind")
    return both.transform(mapped, run, f"did {kind}, n_tokens long, ids array<int>").withColumnRenamed("did", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds column text: the pieces of the ids in order, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    names = [c for c in encoded.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema) + ", text string"
    where = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(tokenizer_path)
        for batch in batches:
            at = 0
            for lists in _word_lists(batch.column(where), _WORDS_PLACED):
                offsets = np.asarray(lists.offsets).astype(np.int64)
                found = table.take(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
                ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)[offsets - offsets[0]]
                data = found.buffers()[2]
                data = data.to_pybytes() if data is not None else b""
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                part = batch.slice(at, len(lists))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "text"])
                at += len(lists)
            pa.default_memory_pool().release_unused()

    return encoded.select(*names).transform(mapped, run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """op6: ids and round trip of all documents."""
    path = default_tokenizer()
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
