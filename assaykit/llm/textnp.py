"""Vectorised hashing of words and characters over Arrow strings.

All functions take the UTF-8 bytes of several texts laid end to end and work on whole arrays; texts are processed in
slices of bounded bytes, so memory does not depend on the batch. A single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.ones(1, np.uint64)

#: Bytes of ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII capitals to small letters.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1024, 2 * len(_POWERS)), _R, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows of about limit bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, offsets[at : to + 1] - offsets[at], raw[offsets[at] : offsets[to]]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each text's first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = fold[data]
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return segment_hashes(data, inside, starts), np.searchsorted(starts, offsets)


def segment_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Polynomial hash, finalised, of the runs that begin at starts; bytes that are not inside count nothing."""
    at = np.arange(starts[0], len(data), dtype=np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    at -= np.repeat(starts, lengths)
    value = (data[starts[0] :].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[at]
    value[~inside[starts[0] :]] = 0
    return mixed(np.add.reduceat(value, starts - starts[0]))


def shingles(words: np.ndarray, firsts: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct k-word shingles of each text, sorted by hash; a text of fewer words is one shingle, one of none has none."""
    out = []
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            h = mixed(h + _R) + words[i : len(words) - k + 1 + i]
        h = mixed(h)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            s = np.zeros(1, np.uint64)
            for w in words[a:b]:
                s = mixed(s + _R) + w
            out.append(mixed(s + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A 63-bit key of a set of hashes."""
    if not len(s):
        return -1
    total = np.add.reduce(mixed(s ^ _B), keepdims=True) + np.uint64(len(s))
    return int(mixed(total)[0] >> np.uint64(1))
