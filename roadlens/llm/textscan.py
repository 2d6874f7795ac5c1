"""Whole texts as flat byte arrays: words, hashes and n-grams of many texts at once.

The functions work on one Arrow batch inside a task. Texts are cut into pieces of a few
megabytes on text borders, so that the working arrays stay small; only a single text
longer than a piece makes a larger one. A null text is an empty one. White space is
``[\\x20\\x09-\\x0D]`` throughout."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

SPACE = np.zeros(256, bool)
SPACE[list(_SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the place where each text begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][: len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, and at least one text each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the maximal runs of ``inside`` bytes; runs stop at text borders."""
    first, last = inside.copy(), inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin = offsets[(offsets > 0) & (offsets < len(inside))]
        first[begin] = inside[begin]
        last[begin - 1] = inside[begin - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~SPACE[data], offsets)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all first, as like bytes compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplaned(raw, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, U64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``n`` of them."""
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(size)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums ``S`` such that ``(S[j] - S[i]) * base^-i`` depends on ``data[i:j]`` alone."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes, equal hash."""
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` neighbours; place ``i`` covers ``i .. i+n-1``."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, U64)
    for k in range(n):
        out += hashes[k:k + size] * U64((0xA0761D6478BD642F * (2 * k + 3)) & (2**64 - 1) | 1)
    return mix(out)


def grams(hashes: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the ``n``-grams that lie in one text."""
    size = max(0, len(hashes) - n + 1)
    places = np.flatnonzero(texts[:size] == texts[n - 1:n - 1 + size]) if size else np.zeros(0, np.int64)
    return places, gram_hashes(hashes, n)[places]


def shingle_sets(data, offsets, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) pairs in order of both.

    A text of fewer than ``n`` words has one shingle, all of its words; a text without
    words has none. A-Z count as a-z."""
    data = LOWER[data]
    starts, ends, texts = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    places, values = grams(hashes, texts, n)
    owners = texts[places]
    counts = np.bincount(texts, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(texts, short)
        whole = counts[short].astype(U64) * U64(0xE7037ED1A0B428DB)
        for k in range(n - 1):
            has = counts[short] > k
            at = np.minimum(first + k, len(hashes) - 1)
            whole = np.where(has, mix(whole + hashes[at] * U64(2 * k + 1)), whole)
        owners = np.concatenate([owners, short])
        values = np.concatenate([values, mix(whole)])
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])
        owners, values = owners[new], values[new]
    return owners, values
