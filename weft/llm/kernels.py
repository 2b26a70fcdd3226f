"""Vectorised text kernels (numpy) shared by the operators of this subpackage.

Every kernel takes whole texts as one byte buffer plus document offsets and
never lets a word, n-gram or window cross a document boundary.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
CHUNK_BYTES = 1 << 18

#: Odd multipliers of the hash mixers and the rolling-hash base.
_BASE = U64(0x9E3779B97F4A7C15)
_MIX_A = U64(0xD6E8FEB86659FD93)
_MIX_B = U64(0xA0761D6478BD642F)
_MIX_C = U64(0xE7037ED1A0B428DB)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PLAIN = np.zeros(256, bool)  # bytes of an alphanumeric ASCII or any non-ASCII character
_PLAIN[0x30:0x3A] = _PLAIN[0x61:0x7B] = True
_PLAIN[0x80:] = True


def mix(x: np.ndarray, by: np.uint64 = _MIX_A) -> np.ndarray:
    """Scramble 64-bit values; a bijection, so it never adds collisions."""
    x = x ^ (x >> U64(32))
    x *= by
    x ^= x >> U64(29)
    x *= _MIX_B
    x ^= x >> U64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _MIX_C) | U64(1)


_POWERS_KEPT = 1 << 19  # 8 MB; a longer buffer's are made anew


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, _BASE)]).astype(U64))
        down = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, inverse)]).astype(U64))
    return up, down


_kept_powers = functools.cache(lambda: _make_powers(_POWERS_KEPT))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if n > _POWERS_KEPT:
        return _make_powers(n)
    up, down = _kept_powers()
    return up[:n], down[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: slice hashes follow by one subtraction."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the slices [start, end), alike for equal slices anywhere."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def rolling_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every slice of the given width."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U64)
    _, down = powers(n)
    return mix((sums[width:] - sums[:n]) * down)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of the given width, by doubling."""
    if len(x) < width:
        return x[:0]
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:n], x[rest : rest + n])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data, offsets


def document_chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole documents; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and the index of each document's first word.

    Words are runs of non-white-space bytes, or with plain runs of lower-case
    ASCII letters, digits and non-ASCII characters.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _PLAIN[data] if plain else ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


_BLOCKS = 32  # of eight bytes; longer words are hashed one by one
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every word, eight bytes after another through the mixer.

    A polynomial would not do: modulo a power of two, different words of a
    regular form (Thue and Morse's, say) are equal for every base.
    """
    sizes = ends - starts
    out = mix(sizes.astype(U64), _MIX_C)
    if not len(starts):
        return out
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    live = np.flatnonzero(sizes <= 8 * _BLOCKS)
    for k in range(_BLOCKS):
        live = live[sizes[live] > 8 * k]
        if not len(live):
            break
        block = eight[starts[live] + 8 * k].view("<u8").ravel() & _TAIL[np.minimum(sizes[live] - 8 * k, 8)]
        out[live] = mix(out[live] ^ block)
    for i in np.flatnonzero(sizes > 8 * _BLOCKS).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    """A value for each byte alone."""
    return _BYTE[data]


BYTE_REACH = 7  # bytes that a value of byte_grams() looks ahead
WORD_REACH = 1


def byte_grams(data: np.ndarray) -> np.ndarray:
    """A hash of the eight bytes from each place on, zeros beyond the end: polynomials over these keep no algebra of the bytes."""
    x = np.concatenate([data, np.zeros(BYTE_REACH, np.uint8)]).astype(U64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << U64(8 * k)
    return mix(x)


def word_grams(words: np.ndarray) -> np.ndarray:
    """A hash of each word and the one after it."""
    return mix(words + mix(np.append(words[1:], U64(0)), _MIX_C)) if len(words) else words


def anchored_runs(values: np.ndarray, offsets: np.ndarray, window: int, anchor: int, reach: int = 0):
    """Cut all windows of a symbol sequence into runs that share the place of their trigger.

    A window's trigger is the smallest rolling hash among its sub-slices of
    `anchor` symbols; it depends on the window's content alone, so equal
    windows have equal triggers wherever they stand. A value may depend on the
    `reach` symbols after its own. Returns document index, first window, number
    of windows, trigger hash and content hash of each run, and the window hashes.
    """
    sums = prefix_sums(values)
    n = len(values) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty, np.zeros(0, U64)
    whole = rolling_hashes(sums, window - reach)[:n]
    inner = mix(rolling_hashes(sums, anchor - reach), _MIX_C)
    trigger = sliding_min(inner, window - anchor + 1)[:n]
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)[:n]
    valid = np.arange(n) + window <= offsets[1:][owner]
    new = np.ones(n + 1, bool)
    left = inner[: n - 1] == trigger[:-1]  # the trigger's place leaves the window
    new[1:n] = left | (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    bounds = np.flatnonzero(new)
    first, last = bounds[:-1], bounds[1:] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    content = mix(slice_hashes(sums, first, last + window - reach) + (last - first).astype(U64), _MIX_C)
    doc = owner[first]
    return doc, first - offsets[doc], last - first + 1, trigger[first].view(np.int64), content.view(np.int64), whole


def cover(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `length` places lie in some [start, end)."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def suffix_ranks(text: np.ndarray, window: int) -> np.ndarray:
    """The rank of the suffix at every place of text, cut at `window` bytes, by prefix doubling; equal ones share a rank.

    The suffix array of the buffer by indexes alone: eight bytes are ranked as a
    number, then twice as many by pairs of ranks, and so on. Suffixes shorter
    than the window count as filled up with zeros.
    """
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.sliding_window_view(wide, 8)[:n].copy().view(">u8").ravel().astype(U64)
    width = min(8, window)
    if width < 8:
        key >>= U64(8 * (8 - width))
    while True:
        _, rank = np.unique(key, return_inverse=True)
        if width >= window:
            return rank
        step = min(width, window - width)
        key = rank.astype(U64) + U64(1) << U64(32)
        key[: n - step] |= rank[step:].astype(U64) + U64(1)
        width += step


def window_ranks(phrases: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix rank of every window of some phrases, one phrase after another, and their numbers of windows."""
    sizes = np.array([len(p) for p in phrases])
    n = sizes - window + 1
    ends = np.cumsum(n)
    places = np.arange(ends[-1]) + np.repeat(np.cumsum(sizes) - sizes - (ends - n), n)
    return suffix_ranks(np.frombuffer(b"".join(phrases), np.uint8), window)[places], n
