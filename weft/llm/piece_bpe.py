"""Encoding and decoding with a BPE model of pieces, by vectorised merge rounds.

Spark hands each worker batches of whole texts. White space becomes the space
symbol, and a text is cut before each run of spaces that follows another
character, and between characters that stand beside each other in no piece: no
merge crosses such a place. The distinct words of some texts are encoded together:
their characters lie in one flat array of symbols; each round finds the best
(smallest) rank of a pair within every word, merges that pair at once at its leftmost
occurrences that do not overlap, and closes the gaps; words without a pair leave
the arrays, until none remains. Merging an occurrence can make a pair that comes
before the next occurrence; a word in which that happens merges its first occurrence
alone in this round, as one merge after the other would.

Nothing is shuffled; a worker holds a batch, the words of a megabyte of it or of one longer text,
and the ids of at most WORDS_HELD words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.frames import mapped, release, table

SPACE = "▁"
#: Words whose ids a worker keeps; beyond it all are forgotten and encoded again.
WORDS_HELD = 1 << 18
#: Longer words are encoded anew each time, in characters.
LONGEST_HELD = 64
_NONE = np.int32(2**31 - 1)
_SPAN = 1 << 21  # symbols are ids, or behind them characters that are no piece
_DECODED = 1 << 17  # ids at once
_BYTES_AT_ONCE = 1 << 20  # of texts, cut into words
_WORD = re.compile(" *[^ ]+| +")


class Unsupported(ValueError):
    """The model does what these rounds do not: another kind, a normaliser, pieces of the user."""


@dataclass(frozen=True)
class Pieces:
    """A model as arrays: pairs of symbols by key with what they make and its rank, characters, and what ids decode to."""

    keys: np.ndarray
    made: np.ndarray
    ranks: np.ndarray
    characters: np.ndarray  # id of each code point, or where it is no piece, itself behind all ids
    neighbours: np.ndarray  # sorted keys of the characters that stand beside each other in a piece
    fallback: np.ndarray  # id of each byte
    runs: dict[int, list[int]] | None  # ids of a run of spaces, shorter than longest_run
    longest_run: int
    begin: int
    end: int
    size: int
    decoded: pa.Array


def _spaces(ids: dict[str, int], scores: dict[str, float]) -> tuple[dict[int, list[int]] | None, int]:
    """Ids of the runs of spaces, if pieces with more than one space hold nothing else and rank behind all others."""
    several = {p for p in ids if SPACE * 2 in p}
    if not several:
        return None, 0
    if any(p.strip(SPACE) for p in several) or max(scores[p] for p in several) >= min(s for p, s in scores.items() if p not in several and len(p) > 1):
        return None, 0
    longest = max(map(len, several))
    found: dict[int, list[int]] = {}
    for n in range(3 * longest):
        parts = [1] * n
        while True:
            joins = [(-scores[SPACE * (a + b)], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if SPACE * (a + b) in ids]
            if not joins:
                break
            i = min(joins)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        found[n] = [ids[SPACE * p] for p in parts]
    if any(found[n] != [ids[SPACE * longest], *found[n - longest]] for n in range(longest, 3 * longest)):
        return None, 0
    return {n: found[n] for n in range(longest)} | {longest: [ids[SPACE * longest]]}, longest


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    plain = sentencepiece_model_pb2.ModelProto.SentencePiece
    form, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or kinds & {plain.USER_DEFINED, plain.UNUSED}:
        raise Unsupported("only BPE models with byte fallback and without pieces of the user")
    if form.precompiled_charsmap or form.remove_extra_whitespaces or not form.add_dummy_prefix or not form.escape_whitespaces:
        raise Unsupported("only models that keep the text, escape spaces and put one in front")
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == plain.NORMAL}
    scores = {p.piece: p.score for p in model.pieces if p.type == plain.NORMAL}
    if missing := {c for p in ids for c in p} - ids.keys():
        raise Unsupported(f"characters of pieces are no pieces: {sorted(missing)[:5]}")
    rank = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
    size = len(model.pieces)
    pairs = [(ids[p[:k]] * _SPAN + ids[p[k:]], i, rank[scores[p]]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    keys, made, ranks = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
    characters = np.arange(0x110000, dtype=np.int64) + size
    for p, i in ids.items():
        if len(p) == 1:
            characters[ord(p)] = i
    beside = np.unique(np.array([characters[ord(a)] * _SPAN + characters[ord(b)] for p in ids for a, b in zip(p, p[1:], strict=False)], np.int64))
    fallback = np.zeros(256, np.int64)
    decoded = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
    for i, p in enumerate(model.pieces):
        if p.type == plain.BYTE:
            fallback[int(p.piece[1:-1], 16)] = i
            decoded[i] = bytes([int(p.piece[1:-1], 16)])
        elif p.type == plain.CONTROL:
            decoded[i] = b""
        elif p.type == plain.UNKNOWN:
            decoded[i] = model.trainer_spec.unk_surface.encode()
    begin, end = (next(i for i, p in enumerate(model.pieces) if p.piece == x and p.type == plain.CONTROL) for x in (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
    runs, longest = _spaces(ids, scores)
    del model, pairs
    release()
    return Pieces(keys, made, ranks, characters, beside, fallback, runs, longest, begin, end, size, pa.array(decoded, pa.large_binary()))


def _looked_up(model: Pieces, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair, _NONE where it is no piece, and what it makes."""
    key = left * _SPAN + right
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    hit = model.keys[at] == key
    return np.where(hit, model.ranks[at], _NONE), np.where(hit, model.made[at], 0)


def _lefts(chosen: np.ndarray) -> np.ndarray:
    """Of places in order, those that stay when each takes the next place away: every other one of a row of neighbours."""
    first = np.flatnonzero(np.diff(chosen, prepend=-2) != 1)
    start = np.repeat(first, np.diff(first, append=len(chosen)))
    return chosen[(np.arange(len(chosen)) - start) % 2 == 0]


def merge_rounds(model: Pieces, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each word after all merges: word numbers ascend, and both results are in the order of the input."""
    symbols, word = symbols.astype(np.int64), word.astype(np.int64)
    place = np.arange(len(symbols))
    rank, made = np.full(len(symbols), _NONE, np.int64), np.zeros(len(symbols), np.int64)
    rank[:-1], made[:-1] = _looked_up(model, symbols[:-1], symbols[1:])
    rank[:-1][word[:-1] != word[1:]] = _NONE
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(symbols):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        length = np.diff(starts, append=len(symbols))
        best = np.minimum.reduceat(rank, starts)
        if (best == _NONE).any():
            over = np.repeat(best == _NONE, length)
            done.append((place[over], symbols[over], word[over]))
            symbols, word, place, rank, made = (x[~over] for x in (symbols, word, place, rank, made))
            continue
        owner = np.repeat(np.arange(len(starts)), length)
        chosen = _lefts(np.flatnonzero(rank == best[owner]))
        symbols, word, place, rank, made = _merged(model, symbols, word, place, rank, made, best, owner, chosen)
    if not done:
        return symbols, word
    order = np.argsort(np.concatenate([d[0] for d in done]), kind="stable")
    return np.concatenate([d[1] for d in done])[order], np.concatenate([d[2] for d in done])[order]


def _merged(model: Pieces, symbols, word, place, rank, made, best, owner, chosen):
    """The arrays after merging at the chosen places, or at the first of a word where a new pair would have come before the next place."""
    new, end = made[chosen], len(symbols)
    right = chosen + 2
    has_right = (right < end) & (word[np.minimum(right, end - 1)] == word[chosen])
    after = np.where(has_right, symbols[np.minimum(right, end - 1)], -1)
    onward, _ = _looked_up(model, new, np.maximum(after, 0))
    onward[~has_right] = _NONE
    has_left = (chosen > 0) & (word[np.maximum(chosen - 1, 0)] == word[chosen])
    before = symbols[np.maximum(chosen - 1, 0)].copy()
    joined = np.flatnonzero(np.diff(chosen, prepend=-5) == 2)  # the left neighbour is merged as well
    before[joined] = new[joined - 1]
    backward, _ = _looked_up(model, np.where(has_left, before, 0), new)
    backward[~has_left] = _NONE
    early = np.minimum(onward, backward) <= best[owner[chosen]]
    if early.any():
        alone = np.zeros(len(best), bool)
        alone[owner[chosen[early]]] = True
        first = np.diff(owner[chosen], prepend=-1) != 0
        stay = first | ~alone[owner[chosen]]
        chosen, new = chosen[stay], new[stay]
    symbols = symbols.copy()
    symbols[chosen] = new
    kept = np.ones(end, bool)
    kept[chosen + 1] = False
    at = np.cumsum(kept) - 1
    symbols, word, place, rank, made = (x[kept] for x in (symbols, word, place, rank, made))
    here = at[chosen]
    touched = np.zeros(len(symbols), bool)
    touched[here] = True
    touched[here[here > 0] - 1] = True
    stale = np.flatnonzero(touched)
    last = stale >= len(symbols) - 1
    inner = stale[~last]
    rank[stale[last]] = _NONE
    rank[inner], made[inner] = _looked_up(model, symbols[inner], symbols[inner + 1])
    rank[inner[word[inner] != word[inner + 1]]] = _NONE
    return symbols, word, place, rank, made


def _run_ids(model: Pieces, spaces: int) -> list[int]:
    whole, rest = divmod(spaces, model.longest_run)
    return model.runs[model.longest_run] * whole + model.runs[rest]


def encode_words(model: Pieces, words: list[str]) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers; a word is a run of spaces, if any, and what follows it."""
    if not words:
        return []
    texts, spaces = words, None
    if model.runs:  # all spaces but the last take no part in other merges
        spaces = [len(w) - len(w.lstrip(" ")) for w in words]
        texts = [w[max(n - 1, 0) :] for w, n in zip(words, spaces, strict=True)]
    flat = np.frombuffer("".join(texts).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
    number = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    symbols = model.characters[flat]
    key = symbols[:-1] * _SPAN + symbols[1:]
    at = np.minimum(np.searchsorted(model.neighbours, key), len(model.neighbours) - 1)
    apart = (model.neighbours[at] != key) | (number[:-1] != number[1:])
    parts = np.concatenate([[0], np.cumsum(apart)])
    out, part = merge_rounds(model, symbols, parts)
    owner = number[np.searchsorted(parts, part)]
    unknown = np.flatnonzero(out >= model.size)
    if len(unknown):
        many = np.ones(len(out), np.int64)
        raw = [chr(c - model.size).encode("utf-8", "replace") for c in out[unknown].tolist()]
        many[unknown] = np.fromiter(map(len, raw), np.int64, len(raw))
        is_raw = np.repeat(out >= model.size, many)
        out, owner = np.repeat(out, many), np.repeat(owner, many)
        out[is_raw] = model.fallback[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.searchsorted(owner, np.arange(len(words) + 1))
    data = out.astype("<u4").tobytes()
    found = [data[a * 4 : b * 4] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
    if spaces:
        lone = int(model.characters[ord(SPACE)])
        for i, n in enumerate(spaces):
            if n > 1:
                free = int.from_bytes(found[i][:4], "little") == lone
                found[i] = np.array(_run_ids(model, n - 1 + free), "<u4").tobytes() + found[i][4 * free :]
    return found


def _words(text: str) -> list[str]:
    """A text cut before each run of spaces, with the space that is put in front of all; a word with one space stands without it where all are such."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if not text or text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ") if text else []
    return _WORD.findall(" " + text)


def _some(texts: pa.Array) -> Iterator[list[str]]:
    """Texts of about _BYTES_AT_ONCE bytes together; a longer one stands alone."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _BYTES_AT_ONCE, "right")) - 1)
        yield texts.slice(i, j - i).to_pylist()
        i = j


@functools.lru_cache(maxsize=1)
def _known(path: str) -> dict[str, bytes]:
    """The ids of words that this worker has encoded, in whatever task."""
    return {}


def _texts_to_ids(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    first, last = (int(i).to_bytes(4, "little") for i in (model.begin, model.end))
    known = _known(path)
    for batch in batches:
        ids: list[bytes] = []
        for texts in _some(batch.column(1)):
            lists = [_words(t) for t in texts]
            every = set().union(*lists)
            new = every.difference(known)
            if len(known) + len(new) > WORDS_HELD:
                known.clear()
                new = every
            fresh = list(new)
            known.update(zip(fresh, encode_words(model, [w if w[:1] == " " else " " + w for w in fresh]), strict=True))
            ids += [b"".join([first, *map(known.__getitem__, words), last]) for words in lists]
            for w in fresh:
                if len(w) > LONGEST_HELD:
                    del known[w]
        sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(ids, pa.binary())], names=["did", "n_tokens", "ids"])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens and ids (little-endian unsigned 32-bit integers), as of the whole text with begin and end ids.

    Null and empty texts have the begin and end ids alone; repeated rows and null
    ids are kept as they are; other columns of docs are ignored, whatever their
    names; an empty table gives no rows. A text longer than a batch is one batch;
    a round costs as much as the words that still merge are long, and a word has as
    many rounds as it merges different pairs, so that words of millions of characters without a space are slow.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.transform(mapped, functools.partial(_texts_to_ids, model_path), "did long, n_tokens long, ids binary")
    return out.withColumnRenamed("did", id_col)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def _joined(found: pa.Array) -> bytes:
    """The values one behind the other, as an array of its own holds them."""
    data = found.buffers()[2]
    return data.to_pybytes() if data is not None else b""


def _ids_to_texts(path: str, where: int, names: list[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        texts = []
        for ids in batch.column(where):
            flat = np.frombuffer(ids.as_buffer() or b"", "<u4").astype(np.int64)
            text = b"".join(_joined(model.decoded.take(pa.array(flat[i : i + _DECODED]))) for i in range(0, len(flat), _DECODED))
            texts.append(text[text[:1] == b" " :].decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds column text: the pieces of the ids in order without control ids and without the space put in front.

    For ids that encode gave; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text.
    """
    names = [c for c in encoded.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*(f"`{n}`" for n in names)).schema) + ", text string"
    rows = encoded.select(*(f"`{n}`" for n in names))
    return rows.transform(mapped, functools.partial(_ids_to_texts, model_path, names.index(ids_col), names), schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: ids and round trip of all documents."""
    path = default_model()
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
