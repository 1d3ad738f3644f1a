"""Vectorised word splitting and hashing over Arrow string arrays.

A word is a maximal run of bytes outside space and 0x09-0x0D of the UTF-8 text. Everything here works on whole
buffers with numpy, so a text of any length costs a few passes over its bytes and no per-word Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 19
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
#: Of a second hash that is independent of the first.
_OTHER_BASE, _OTHER_VALUES = 0xC2B2AE3D27D4EB4F, mix64(np.arange(1, 257, dtype=U64) * U64(0x165667B19E3779F9))
_OTHER_INV = pow(_OTHER_BASE, -1, 1 << 64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, _CHUNK + 4096), base, U64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if n <= 4 * _CHUNK:
            _POWERS[base] = got
    return got[:n]


@dataclass
class Words:
    """Words of a batch of texts: byte ranges in data, and per text the index of its first word (first has n + 1 entries)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def give_back() -> None:
    """Returns memory that is free to the system. A Python worker is kept for the next task, and would keep its peak with it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, separators: np.ndarray = _SPACE) -> Words:
    """separators: for each byte, whether it lies between words."""
    data, offsets = buffers(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    solid = ~separators[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = solid[edge]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] = solid[last]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def word_hashes(words: Words, lower: bool = False, other: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes; lower folds A-Z only; other gives another hash, independent of this one."""
    values, base, inverse = (_OTHER_VALUES, _OTHER_BASE, _OTHER_INV) if other else (_VALUES, _BASE, _BASE_INV)
    values = values[_LOWER] if lower else values
    out = np.empty(len(words.start), U64)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(words.end, words.start[lo] + _CHUNK, "right")))
        at, upto = int(words.start[lo]), int(words.end[hi - 1])
        sums = np.zeros(upto - at + 1, U64)
        np.cumsum(values[words.data[at:upto]] * _powers(base, upto - at), out=sums[1:])
        begin = words.start[lo:hi] - at
        out[lo:hi] = (sums[words.end[lo:hi] - at] - sums[begin]) * _powers(inverse, upto - at)[begin]
        lo = hi
    return mix64(out + (words.end - words.start).astype(U64))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive entries (len - width + 1 of them), whatever texts they belong to."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    power = 1
    for k in range(width if width <= 4 else 0):
        power = power * _BASE % (1 << 64)
        out += hashes[k : k + n] * U64(power)
    if width > 4:
        step = 1 << 18
        for lo in range(0, n, step):
            m = min(step, n - lo)
            sums = np.zeros(m + width, U64)
            np.cumsum(hashes[lo : lo + m + width - 1] * _powers(_BASE, m + width - 1), out=sums[1:])
            out[lo : lo + m] = (sums[width:] - sums[:m]) * _powers(_BASE_INV, m)
    return mix64(out)


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Indices, among all entries of texts with these counts, at which a run of width stays inside its text."""
    total = int(counts.sum())
    ok = np.ones(total, bool)
    ends = np.cumsum(counts)
    for k in range(1, width):
        ok[(ends - k)[counts >= k]] = False
    return np.flatnonzero(ok)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together have about limit bytes, or one text each beyond that."""
    _, offsets = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold limit bytes."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield _joined(held)
            size = 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all; the list is emptied, so that they are not held beside it."""
    whole = pa.Table.from_batches(batches).combine_chunks()
    batches.clear()
    return whole.to_batches()[0]


def ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of values[first[i] : first[i] + size[i]]."""
    total = int(size.sum())
    if not total:
        return values[:0]
    keep = size > 0
    first, size = first[keep], size[keep]
    step = np.ones(total, np.int64)
    step[0] = first[0]
    at = np.cumsum(size)[:-1]
    step[at] = first[1:] - first[:-1] - size[:-1] + 1
    return values[np.cumsum(step)]
