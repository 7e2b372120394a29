"""Whole-batch tokenising of Arrow text columns with NumPy; no loop over documents or words.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, A-Z lowered. Its hash is a
64-bit polynomial over random byte values with a final mixing, equal for equal words on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = U(0x9E3779B97F4A7C15)
_R_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _R)
_SEGMENT = 1 << 20
_powers = {"n": 0, "up": np.empty(0, U), "down": np.empty(0, U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, _SEGMENT)
        for name, base in (("up", _R), ("down", _R_INV)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span (sorted, not empty), wherever it stands; memory for a segment at a time."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _SEGMENT, side="right")))
        base = start[at]
        up, down = _power(int(end[to - 1] - base))
        value = _BYTE[data[base : end[to - 1]]]
        value *= up[: len(value)]
        total = np.cumsum(value, dtype=U)
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((total[e - 1] - total[s] + value[s]) * down[s])
        at = to
    return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary array; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of consecutive documents: hash, start and end of each; doc[i]:doc[i+1] are those of document i.

    Beside the text itself this takes 24 bytes a word; all else is held for a segment at a time (a longer word alone).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashes: bool = True):
        self.data = data = _LOWER[data] if lower else data
        starts, ends = [], []
        for a in range(0, len(data), _SEGMENT):
            # one byte more on each side; documents begin and end words too
            lo, hi = max(0, a - 1), min(len(data), a + _SEGMENT + 1)
            word = _IS_WORD[data[lo:hi]]
            begins = np.zeros(hi - lo + 1, bool)
            begins[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo] = True
            start, end = word.copy(), word.copy()
            start[1:] &= ~word[:-1] | begins[1 : len(word)]
            end[:-1] &= ~word[1:] | begins[1 : len(word)]
            own = slice(a - lo, a - lo + min(_SEGMENT, len(data) - a))
            starts.append(np.flatnonzero(start[own]) + a)
            ends.append(np.flatnonzero(end[own]) + a + 1)
        self.start, self.end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends))
        self.doc = np.searchsorted(self.start, offsets)
        if hashes:
            self.hash = span_hashes(data, self.start, self.end)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `most` bytes of text (a longer document stands alone), as (slice, bytes, offsets)."""
    for batch in batches:
        data, offsets = raw(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    pa.default_memory_pool().release_unused()  # the worker stays for other tasks


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    if not len(values):
        return values, np.empty(0, np.int64)
    v = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    return v[at], np.diff(np.append(at, len(v)))
