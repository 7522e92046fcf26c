"""Vectorised word hashing over Arrow text columns.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``; all of those are ASCII, so the
rule may be applied to UTF-8 bytes directly.  A word's 64-bit hash is a polynomial over per-byte
random values (derived from splitmix64), finished with splitmix64's mixer and its length, so whole
batches are hashed by a handful of NumPy passes and no Python string is made.

Nulls count as empty texts.  Work is cut into blocks of at most ``BLOCK`` bytes at white space, so
memory stays bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    v = mix64((np.arange(1, 257, dtype=_U)) * _U(_GOLD))
    if lower:
        v[65:91] = v[97:123]
    return v


_VALUES = {flag: _byte_values(flag) for flag in (False, True)}
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        inv = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inv):
            a = np.full(size, b & _MASK, dtype=_U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[0] = have = (out[0], out[1])
    return have


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a text's ends always end a word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(raw), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, values: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of raw[start:end] for ascending spans, in blocks; other ``values`` of bytes give another hash."""
    out = np.empty(len(starts), dtype=_U)
    values, i = _VALUES[lower] if values is None else values, 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(int(np.searchsorted(ends, lo + BLOCK, side="right")), i + 1)
        hi = int(ends[j - 1])
        up, down = _pow(hi - lo + 1)
        prefix = np.zeros(hi - lo + 1, dtype=_U)
        np.cumsum(values[raw[lo:hi]] * up[: hi - lo], out=prefix[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((prefix[e] - prefix[s]) * down[s] + (e - s).astype(_U) * _U(_GOLD))
        i = j
    return out


def words_of(col: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, index of each text's first word with a closing total)."""
    raw, offsets = text_buffers(col)
    starts, ends = word_bounds(raw, offsets)
    return hash_spans(raw, starts, ends, lower), np.searchsorted(starts, offsets, side="left")


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words in one array; run i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    acc = np.full(n, _U(k))
    for i in range(k):
        acc = mix64(acc * _U(_BASE) + words[i : i + n])
    return acc


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A text's distinct k-word shingles, ascending; with fewer words the whole sequence is one."""
    if not len(words):
        return np.zeros(0, dtype=_U)
    return np.unique(windows(words, min(k, len(words))))


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The lower-cased shingle set of each text."""
    words, first = words_of(col, lower=True)
    runs = windows(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(runs[a : b - k + 1]) if b - a >= k else shingles(words[a:b], k)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1, i + 1)
            yield batch.slice(i, j - i)
            i = j
