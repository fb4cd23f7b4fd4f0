"""Vectorised word and shingle fingerprints over Arrow string columns, two independent ones of 64 bits each.

Everything works on the contiguous UTF-8 buffer of an Arrow array, a bounded
segment at a time, so memory follows the segment size and the number of words,
not the size of a batch. Fingerprints depend only on the bytes of the words:
they are equal on every executor and in every run.

A word is read in lanes of eight bytes. Each lane goes into both states through
bijections of their own, so words of up to eight bytes and one length never share
a fingerprint, and there is no structure by which longer ones would. Words of more
than LONG bytes are hashed by BLAKE2b.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")
_SHINGLES = np.array([0xD6E8FEB86659FD93, 0xA3B195354A39B70D], np.uint64)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_N1 = np.uint64(0xFF51AFD7ED558CCD)
_N2 = np.uint64(0xC4CEB9FE1A85EC53)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0x8EBC6AF09C88C6E3], np.uint64)
#: The low bytes of a lane that belong to a word of which so many are left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG = 256
#: Bytes hashed at once; a longer word stretches its segment.
SEGMENT = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII white space: space and \t \n \v \f \r.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """A table that a worker process keeps for the next tasks of its kind; it has one such table at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def fresh_memory() -> None:
    """At the start of a task that keeps nothing: drop what another kind of task kept."""
    _kept.clear()
    release_memory()


def release_memory() -> None:
    """Give what a finished task held back to the system, since workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def mix_other(h: np.ndarray) -> np.ndarray:
    """Another bijective finaliser."""
    h = (h ^ (h >> np.uint64(33))) * _N1
    h = (h ^ (h >> np.uint64(33))) * _N2
    return h ^ (h >> np.uint64(33))


def fingerprints(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each stretch data[begin:end]."""
    size = ends - begins
    first = mix(size.astype(np.uint64) * _SHINGLES[0] + _SEEDS[0])
    second = mix_other(size.astype(np.uint64) * _SHINGLES[1] + _SEEDS[1])
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    large = np.flatnonzero(size > LONG)
    now = np.flatnonzero(size <= LONG) if len(large) else None
    at, left = (begins, size) if now is None else (begins[now], size[now])
    while len(at):
        lane = lanes[at] & _MASKS[np.minimum(left, 8)]
        if now is None:
            first, second = mix(first ^ lane), mix_other(second + lane * _SHINGLES[1])
            now = np.flatnonzero(left > 8)
            more = now
        else:
            first[now], second[now] = mix(first[now] ^ lane), mix_other(second[now] + lane * _SHINGLES[1])
            more = np.flatnonzero(left > 8)
            now = now[more]
        at, left = at[more] + 8, left[more] - 8
    for i in large.tolist():
        digest = hashlib.blake2b(data[begins[i] : ends[i]], digest_size=16).digest()
        first[i], second[i] = np.frombuffer(digest, "<u8")
    return first, second


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row bounds of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32) if bounds is not None else np.zeros(1, np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that end at a row's end or at white space."""
    start, end = 0, len(data)
    while start < end:
        stop = start + SEGMENT
        if stop >= end:
            stop = end
        else:
            row = int(np.searchsorted(bounds, stop, "right")) - 1
            if bounds[row] > start:
                stop = int(bounds[row])
            else:
                limit, at = int(bounds[row + 1]), stop
                while at < limit:
                    hit = np.flatnonzero(_SPACE[data[at : min(at + 4096, limit)]])
                    if len(hit):
                        at += int(hit[0])
                        break
                    at = min(at + 4096, limit)
                stop = at
        yield start, stop
        start = stop


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both fingerprints of all white-space-separated words, A-Z lower-cased, and row bounds into them."""
    data, bounds = buffers(column)
    found: tuple[list, list] = ([], [])
    counts = np.zeros(len(bounds) - 1, np.int64)
    for start, stop in _segments(data, bounds):
        piece = _LOWER[data[start:stop]]
        n = stop - start
        inside = ~_SPACE[piece]
        edge = np.zeros(n + 1, bool)
        edge[0] = edge[n] = True
        rows = bounds[(bounds >= start) & (bounds <= stop)] - start
        edge[rows] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        begins = np.flatnonzero(inside & (~before | edge[:n]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        if not len(begins):
            continue
        for out, h in zip(found, fingerprints(piece, begins, ends), strict=True):
            out.append(h)
        row = np.searchsorted(bounds, begins + start, "right") - 1
        counts += np.bincount(row, minlength=len(counts))
    first, second = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found)
    return first, second, np.concatenate([[0], np.cumsum(counts)])


def slices(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, pa.Array]]:
    """Stretches of a string column of about `limit` bytes (one row at least), each with its first row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield first, column.slice(first, last - first)
        first = last


def shingle_sets(column: pa.Array, k: int, see: Callable[[np.ndarray], None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct k-word shingles by the first fingerprint and by the second, both sorted.

    Fewer words make one shingle, none an empty set. see gets the words' first fingerprints, some rows' at a time.
    """
    for _, part in slices(column):
        for first, second, _ in _shingle_sets(part, k, see, None):
            yield first, second


def weighed_sets(column: pa.Array, k: int, weight: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """shingle_sets, and the sum of its words' weights for each first fingerprint (0 for a shingle of fewer words)."""
    for _, part in slices(column):
        yield from _shingle_sets(part, k, None, weight)


def _shingle_sets(column: pa.Array, k: int, see: Callable | None, weight: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    *both, at = words(column)
    if see is not None:
        see(both[0])
    own = np.zeros(0, np.int64) if weight is None else weight(both[0])
    heavy = own.copy()
    rolled = []
    for h, step, finish in zip(both, _SHINGLES, (mix, mix_other), strict=True):
        r = h.copy()
        for j in range(1, min(k, len(h))):
            r = r * step
            r[: len(h) - j] += h[j:]
        rolled.append(finish(r))
    for j in range(1, min(k, len(own))):
        heavy[: len(own) - j] += own[j:]
    empty, none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k and weight is None:
            yield np.unique(rolled[0][a : b - k + 1]), np.unique(rolled[1][a : b - k + 1]), none
        elif b - a >= k:
            first, where = np.unique(rolled[0][a : b - k + 1], return_index=True)
            yield first, np.unique(rolled[1][a : b - k + 1]), heavy[a + where]
        elif b > a:
            yield _single(both[0][a:b], _SHINGLES[0], mix), _single(both[1][a:b], _SHINGLES[1], mix_other), np.zeros(1, np.int64)
        else:
            yield empty, empty, none


def _single(h: np.ndarray, step: np.uint64, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The one shingle of a document of fewer words than a shingle has."""
    one = np.array([len(h)], np.uint64)
    for x in h:
        one = finish(one * step + x)
    return one
