"""Words, word hashes and shingles of whole texts, as numpy arrays over one Arrow column.

A word is a maximal run of bytes other than space and the controls 0x09 to 0x0D. Those bytes never
occur inside a longer UTF-8 sequence, so cutting bytes and cutting characters are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RANDOM = np.random.default_rng(20_240_607)
#: A random number for each byte value, and the odd base of the polynomial hashes.
BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 2**64))

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of longer characters, for words without punctuation.
_PUNCTUATION = np.ones(256, bool)
_PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """The Rabin-Karp hash of every ``width`` consecutive values: sum of value * BASE ** place, modulo 2 ** 64."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    return mix((sums[width:] - sums[: n - width + 1]) * powers(INVERSE, n - width + 1))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each text begins (one more entry for the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # still in chunks if there are none
        column = pa.array([], pa.large_binary())
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """Words of several texts: ``data`` and ``bounds`` of the texts, then start, end, text and hash of each word."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The number of the first word of each text, and of the word after the last."""
        return np.searchsorted(self.text, np.arange(len(self.bounds)))


def cut(column: pa.Array | pa.ChunkedArray, lower: bool = False, punctuation: bool = True) -> Words:
    """Cut every text into words. ``lower`` lower-cases A-Z first; ``punctuation=False`` cuts at ASCII punctuation too."""
    data, bounds = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = ~(_SEPARATOR if punctuation else _PUNCTUATION)[data]
    edge = np.zeros(len(data) + 1, bool)  # a text's first byte never goes on with the word before
    edge[bounds] = True
    before = np.concatenate([[False], inside])[:-1] & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]])[: len(inside)] & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(bounds, start, "right") - 1
    return Words(data, bounds, start, end, text.astype(np.int64), _hashes(data, start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], length)
    codes = BYTE_CODES[data[place + np.repeat(start, length)]]
    codes *= powers(BASE, int(length.max()))[place]
    return mix(np.add.reduceat(codes, first[:-1]) + length.astype(np.uint64))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one text, and the text of each.

    A text with fewer words has one shingle, its whole sequence; a text without words has none.
    """
    first = words.first
    counts = np.diff(first)
    hashes = rolling(words.hash, width)
    at = np.arange(len(hashes))
    fits = words.text[at] == words.text[at + width - 1] if len(hashes) else np.zeros(0, bool)
    hashes, texts = hashes[fits], words.text[at[fits]]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        # A shorter sequence is hashed with its length, so that it never equals a full shingle.
        whole = np.array(
            [_sequence(words.hash[first[i] : first[i + 1]]) for i in short], dtype=np.uint64
        )
        hashes = np.concatenate([hashes, whole])
        texts = np.concatenate([texts, short])
        order = np.argsort(texts, kind="stable")
        hashes, texts = hashes[order], texts[order]
    return hashes, texts


def _sequence(hashes: np.ndarray) -> np.uint64:
    total = np.add.reduce(hashes * powers(BASE, len(hashes)), dtype=np.uint64)
    return mix(np.array([total + U64(len(hashes))]) ^ BASE)[0]
