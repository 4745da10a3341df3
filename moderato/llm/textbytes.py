"""Vectorised views of string columns inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20   # text handled at once inside a task
PIECE_BYTES = 1 << 19   # of a text, whose words are hashed at once


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its ``len + 1`` offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row, if that is longer)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows: what a task makes of them is held for few rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        grown = []
        for b in (_BASE, _UNBASE):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        _powers[:] = grown
    return _powers[0], _powers[1]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each byte range ``[start, end)``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > PIECE_BYTES and len(starts) > 1 and (starts[1:] >= ends[:-1]).all():
        out, i = [], 0              # a long text's words, a piece of it at a time
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")))
            out.append(range_hashes(data[starts[i]:ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]))
            i = j
        return np.concatenate(out)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; no run crosses a row."""
    edge = np.zeros(len(is_word) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(is_word) + 1, bool)
    before[1:] = is_word
    here = np.zeros(len(is_word) + 1, bool)
    here[:-1] = is_word
    return np.flatnonzero(here & (~before | edge)), np.flatnonzero(before & (~here | edge))


#: For each byte, whether it belongs to a word: all but space and 0x09 to 0x0D.
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per row, the sorted distinct 64-bit hashes of its ``k``-word shingles.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  A
    row of fewer words has its whole sequence as one shingle; a row without
    words has an empty set."""
    low = lower_ascii(data)
    starts, ends = word_spans(_WORD[low], offsets)
    words = range_hashes(low, starts, ends)
    first = np.searchsorted(starts, offsets[:-1])
    last = np.append(first[1:], len(starts))
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    salt = np.arange(1, k + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) | np.uint64(1)
    for j in range(k):
        rolled += words[j:j + n] * mix(salt[j:j + 1])[0]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif b > a:
            part = (words[a:b] * mix(salt[:b - a])).sum(dtype=np.uint64)
            out.append(mix(np.array([part + np.uint64((b - a) * 0x632BE5AB)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
