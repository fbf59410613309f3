"""Vectorised words and rolling hashes over Arrow string columns.

A word is a maximal run of bytes other than space and U+0009..U+000D.  UTF-8
never uses those bytes inside a longer character, so words can be cut on raw
bytes.  Whole chunks of documents are hashed with a few numpy passes; there is
no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 5)
_GRAM_BASE = U64(0xD6E8FEB86659FD93 | 5)
_GRAM_BASE_2 = U64(0xA0761D6478BD642F | 5)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of text handled at once, which bounds the working memory of a Python worker.
CHUNK_BYTES = 1 << 19


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        inverse = U64(pow(key, -1, 1 << 64))
        forward, backward = np.full(size, base, U64), np.full(size, inverse, U64)
        forward[0] = backward[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[key] = np.cumprod(forward), np.cumprod(backward)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """The words of a chunk of documents."""

    data: np.ndarray  # bytes of all documents of the chunk
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # word index at which each document begins, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """Document (row of the chunk) of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = _utf8(column)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = solid[edges]  # a document's first byte opens a word even after a word
    closes[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if len(data):
        forward, backward = _power_tables(_BASE, len(data))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTES[data] * forward)])
            hashes = mix((total[ends] - total[starts]) * backward[starts] + (ends - starts).astype(U64))
    else:
        hashes = np.zeros(0, U64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def grams(w: Words, n: int, second: bool = False) -> np.ndarray:
    """Hash of each run of n words, by first word; runs that leave their document are meaningless (see ``inside``)."""
    size = len(w.hashes) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    forward, backward = _power_tables(_GRAM_BASE_2 if second else _GRAM_BASE, len(w.hashes))
    with np.errstate(over="ignore"):
        source = mix(w.hashes ^ U64(0x5851F42D4C957F2D)) if second else w.hashes
        total = np.concatenate([np.zeros(1, U64), np.cumsum(source * forward)])
        return mix((total[n:] - total[:-n]) * backward[:size])


def inside(w: Words, n: int) -> np.ndarray:
    """Which runs of n words stay in one document."""
    size = len(w.hashes) - n + 1
    if size <= 0:
        return np.zeros(0, bool)
    good = np.ones(size, bool)
    for b in (w.bounds[1:-1], ):
        # a run starting less than n words before a boundary crosses it
        cross = np.zeros(size + 1, np.int64)
        inner = np.unique(b[(b > 0) & (b < len(w.hashes))])
        np.add.at(cross, np.clip(inner - n + 1, 0, size), 1)
        np.add.at(cross, np.clip(inner, 0, size), -1)
        good &= np.cumsum(cross[:-1]) == 0
    return good


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    size = len(x) - n + 1
    if size <= 0:
        return x[:0]
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = n - span
    return np.minimum(x[:size], x[rest : rest + size])


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text))
        sizes = np.asarray(pa.compute.fill_null(sizes, 0), np.int64)
        block = (np.cumsum(sizes) - 1).clip(0) // limit
        at = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]])
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield batch.slice(a, b - a)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
