"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of bytes other than space and 0x09-0x0D. A-Z are lower-cased
before hashing. Every function works on one block of documents at a time, so the
memory of a task is bounded by the block size or by its longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts (null: empty) and the n + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64, np.uint64]:
    """Space flags, lower-casing, a random value per byte, and an odd base with its inverse."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    per_byte = np.random.Generator(np.random.PCG64(20240601)).integers(0, 2**64, 256, np.uint64)
    base = 0x9E3779B97F4A7C15
    return space, lower, per_byte, np.uint64(base), np.uint64(pow(base, -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix, a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a block: byte ranges, the row each belongs to, and 64-bit hashes of the lower-cased words."""

    body: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows).astype(np.int64)


def span_hash(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, by prefix sums of position-weighted byte values."""
    _, _, per_byte, base, inverse = byte_tables()
    if not len(start):
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(per_byte[body] * powers(base, len(body)), dtype=np.uint64, out=prefix[1:])
    plain = (prefix[end] - prefix[start]) * powers(inverse, len(body) + 1)[start]
    return mixed(plain + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: pa.Array) -> Words:
    space, lower, _, _, _ = byte_tables()
    body, offsets = raw(texts)
    body = lower[body]
    inside = ~space[body]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] |= inside[heads]
    tails = heads[heads > 0] - 1
    last[tails] |= inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(body, offsets, start, end, row, span_hash(body, start, end))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, rows not regarded; len(hashes) - n + 1 values."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + size]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mixed(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def row_ids(partition: int, done: int, n: int) -> np.ndarray:
    """Row numbers that are unique over the tasks of one job."""
    return (np.int64(partition) << np.int64(36)) + done + np.arange(n, dtype=np.int64)
