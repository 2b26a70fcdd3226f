"""Language identification of mixed-language text.

Per-word scores come from byte n-grams of words, hashed into a table of
log-probabilities per language. The script of a word narrows the candidate
languages. Viterbi over the words of a document, with a penalty for switching,
labels spans; the document's language is the one that labels most words.

The table is fitted on labelled rows: all of them up to TRAIN_ROWS, beyond that
about so many: all rows of the rarer languages, and of each other language the
same number, by a hash of the identifier and the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.llm import kernels as K
from weft.llm.frames import mapped, table

TRAIN_ROWS = 20_000
TABLE_BITS = 16
WIDTHS = (1, 2, 3, 4)
SWITCH_PENALTY = 6.0
_TRAIN_TASKS = 8
_BYTES_AT_ONCE = 3 << 20  # of text; a longer document stands alone
#: First code points of script ranges, in order, and the script from there on (0: none).
SCRIPTS = ((0x41, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xA00, 0), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0))
N_SCRIPTS = 1 + max(s for _, s in SCRIPTS)
_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([0, *(s for _, s in SCRIPTS)])
_LETTER = regex.compile(r"\p{L}")


def _distinct_words(data: np.ndarray, offsets: np.ndarray):
    """(codes of all words, first word of each document, distinct words as bytes joined by marks, their bounds)."""
    starts, ends, first = K.word_bounds(data, offsets, plain=True)
    hashes = K.word_hashes(data, starts, ends)
    _, where, code = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends[where] - starts[where]
    at = np.concatenate([[0], np.cumsum(size + 2)])
    marked = np.full(int(at[-1]), 0x02, np.uint8)
    inner = np.repeat(at[:-1] + 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    marked[inner] = data[np.repeat(starts[where] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))]
    return code.astype(np.int32), first, marked, at


def _grams(marked: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, table cell) of every n-gram of the marked words."""
    sums = K.prefix_sums(K.byte_values(marked))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for width in WIDTHS:
        cells = K.rolling_hashes(sums, width) >> np.uint64(64 - TABLE_BITS)
        n = len(cells)
        inside = np.arange(n) + width <= at[1:][owner[:n]]
        yield owner[:n][inside], cells[inside].astype(np.int64)


def _scripts(marked: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The script of each marked word, by its largest code point, and whether it has a letter."""
    raw = marked.tobytes()
    words = [raw[a + 1 : b - 1].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
    top = np.fromiter((ord(max(w)) if w else 0 for w in words), np.int64, len(words))
    letter = np.fromiter((_LETTER.search(w) is not None for w in words), bool, len(words))
    return _SCRIPT[np.searchsorted(_FROM, top, "right")], letter


class Model:
    """Log-probabilities of the table's cells per language, and which scripts a language is written in."""

    def __init__(self, languages: list[str], cells: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        smooth = cells + 0.5
        self.table = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32).copy()
        self.scripts = scripts / np.maximum(scripts.sum(1, keepdims=True), 1) > 0.002
        self.scripts[:, 0] = True

    def word_scores(self, marked: np.ndarray, at: np.ndarray) -> np.ndarray:
        scores = np.zeros((len(at) - 1, len(self.languages)))
        for owner, cells in _grams(marked, at):
            for k in range(len(self.languages)):
                scores[:, k] += np.bincount(owner, self.table[cells, k], len(at) - 1)
        scores /= len(WIDTHS)
        script, letter = _scripts(marked, at)
        allowed = self.scripts[:, script].T
        scores -= np.where(allowed | ~allowed.any(1, keepdims=True), 0, 50.0)
        scores[~letter] = 0
        return scores.astype(np.float32), letter


def viterbi(codes: np.ndarray, first: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, all documents at once, one position after another."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    n, kinds = len(codes), scores.shape[1]
    label = np.min_scalar_type(-kinds)  # signed, wide enough for every label
    path, back = np.zeros(n, label), np.zeros((n, kinds), label)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # documents longer than each position
    value = np.zeros((len(size), kinds), np.float32)
    own = np.arange(kinds, dtype=label)
    for t in range(longest):
        k = active[t]
        at = start[:k] + t
        if t:
            best = value[:k].argmax(1)
            moved = value[np.arange(k), best] - penalty
            move = moved[:, None] > value[:k]
            back[at] = np.where(move, best[:, None], own)
            value[:k] = np.where(move, moved[:, None], value[:k])
        value[:k] += scores[codes[at]]
    state = value.argmax(1).astype(label)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        path[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return path


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The model of rows (text, lang); None without any. What reaches the driver is one table per task and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(0))
            names = np.array(batch.column(1).to_pylist(), object)
            for i, j, chunk, offs in K.document_chunks(data, offsets, _BYTES_AT_ONCE):
                for name in set(names[i:j]):
                    own = np.flatnonzero(names[i:j] == name)
                    part = b" ".join(chunk[offs[k] : offs[k + 1]].tobytes() for k in own)
                    code, _, marked, at = _distinct_words(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
                    script, letter = _scripts(marked, at)
                    times = np.bincount(code, minlength=len(at) - 1) * letter
                    total, scripts = found.setdefault(name, [np.zeros(1 << TABLE_BITS, np.int64), np.zeros(N_SCRIPTS, np.int64)])
                    for owner, cells in _grams(marked, at):
                        total += np.bincount(cells, times[owner], 1 << TABLE_BITS).astype(np.int64)
                    scripts += np.bincount(script, times, N_SCRIPTS).astype(np.int64)
        for name, (total, scripts) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.astype(np.int32).tobytes()]), pa.array([scripts.tobytes()])], names=["lang", "cells", "scripts"])

    rows = labelled.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.col(lang).alias("lang")).repartition(_TRAIN_TASKS)
    sums: dict[str, list[np.ndarray]] = {}
    for r in rows.transform(mapped, count, "lang string, cells binary, scripts binary").collect():
        total, scripts = sums.setdefault(r.lang, [np.zeros(1 << TABLE_BITS), np.zeros(N_SCRIPTS)])
        total += np.frombuffer(r.cells, np.int32)
        scripts += np.frombuffer(r.scripts, np.int64)
    if not sums:
        return None
    names = sorted(sums)
    return Model(names, np.stack([sums[x][0] for x in names]), np.stack([sums[x][1] for x in names]))


def bounded(labelled: DataFrame, key: Column, most: int = TRAIN_ROWS, text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows, or about `most`: languages below an equal share whole, of the others so many by a hash of key and text."""
    counts = {r[lang]: r["count"] for r in labelled.groupBy(lang).count().collect()}
    if sum(counts.values()) <= most:
        return labelled
    left, share = most, 1
    for i, n in enumerate(sorted(counts.values())):
        share = max(1, left // (len(counts) - i))
        if n > share:
            break
        left -= n
    chance = [x for name, n in counts.items() if n > share for x in (F.lit(name), F.lit(share / n))]
    draw = F.pmod(F.xxhash64(F.lit("train"), key, F.col(text)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return labelled.where(F.coalesce(F.create_map(*chance)[F.col(lang)], F.lit(1.0)) > draw) if chance else labelled


def identify(docs: DataFrame, model: Model | None, penalty: float = SWITCH_PENALTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and lang_spans (start, end, lang; by word) to the rows of docs.

    score is the share of the words with letters that the language labels. Text
    that is null, empty or without any letter, and all text without a model, is
    `und` with score 0 and no spans. Rows and columns are kept as they are but
    for columns of these names, which are replaced.
    """
    names = ("lang_pred", "score", "lang_spans")
    columns = [c for c in docs.columns if c not in names]
    kept = [F.col(f"`{c}`") for c in columns]
    rows = docs.select(*kept, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_".join(["lower", *columns])))  # a name that no column has
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def label(data: np.ndarray, offsets: np.ndarray, model: Model):
        code, first, marked, at = _distinct_words(data, offsets)
        scores, letter = model.word_scores(marked, at)
        path = viterbi(code, first, scores, penalty)
        counts = np.zeros((len(offsets) - 1, len(model.languages)), np.int64)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        has = letter[code]
        np.add.at(counts, (owner[has], path[has]), 1)
        total = counts.sum(1)
        best = counts.argmax(1)
        share = counts.max(1) / np.maximum(total, 1)
        new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])])) if len(path) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(path))
        kind = np.array(model.languages, object)
        spans = pa.StructArray.from_arrays([pa.array((new - first[owner[new]]).astype(np.int32)), pa.array((ends - first[owner[new]]).astype(np.int32)), pa.array(kind[path[new]], pa.string())], fields=list(span))
        bounds = np.searchsorted(owner[new], np.arange(len(offsets)))
        for i in np.flatnonzero(total == 0):
            share[i] = 0
        pred = np.where(total > 0, kind[best], "und")
        return pred, share, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(len(columns)))
            for i, j, part, offs in K.document_chunks(data, offsets, _BYTES_AT_ONCE):
                own = batch.slice(i, j - i).columns[: len(columns)]
                if model is None:
                    out = [pa.array(["und"] * (j - i)), pa.array(np.zeros(j - i)), pa.array([[]] * (j - i), pa.list_(span))]
                else:
                    pred, share, spans = label(part, offs, model)
                    out = [pa.array(pred, pa.string()), pa.array(share), spans]
                yield pa.RecordBatch.from_arrays([*own, *out], names=[*columns, *names])

    schema = StructType([*docs.select(*kept).schema, *StructType.fromDDL("lang_pred string, score double, lang_spans array<struct<start:int,end:int,lang:string>>")])
    return rows.transform(mapped, run, schema)


def has_letter(text: str = "text") -> Column:
    """Whether identify() finds a letter in the text."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the identifier as text has remainder 1 by 3; a null identifier has none."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """op7: languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    model = fit(bounded(labelled, F.col("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
