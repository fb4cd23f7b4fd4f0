"""Content-defined chunking with a keyed gear hash.

A chunk's hash restarts at its minimum length and shifts left by a byte's gear
value, so under a mask of m low bits only the last m bytes matter. That makes the
hash of every position one vectorised expression over the whole buffer; only the
first few positions after a chunk's minimum, where the restart still shows, are
computed one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KIB, MIB = 1 << 10, 1 << 20
MIN_AVG, MAX_AVG, DEFAULT_AVG = KIB, 16 * MIB, MIB
#: Bytes of a decompressed chunk at most.
CHUNK_LIMIT = 64 * MIB
_WORD = (1 << 64) - 1


@dataclass(frozen=True)
class ChunkerParams:
    min_size: int
    avg_size: int
    max_size: int

    @staticmethod
    def from_avg(avg: int) -> ChunkerParams:
        if not MIN_AVG <= avg <= MAX_AVG:
            raise ValueError(f"average chunk size {avg} is not between {MIN_AVG} and {MAX_AVG}")
        return ChunkerParams(avg // 2, avg, 4 * avg)

    @property
    def bits(self) -> int:
        return round(math.log2(self.avg_size))

    @property
    def masks(self) -> tuple[int, int]:
        """The mask before the average size and the one after it."""
        return (1 << (self.bits + 2)) - 1, (1 << max(self.bits - 2, 1)) - 1


@lru_cache(maxsize=16)
def gear_table(seed: int) -> tuple[int, ...]:
    """256 successive outputs of the splitmix64 generator."""
    out, state = [], seed & _WORD
    for _ in range(256):
        state = (state + 0x9E3779B97F4A7C15) & _WORD
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _WORD
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _WORD
        out.append(z ^ (z >> 31))
    return tuple(out)


def cut_points(data: bytes, params: ChunkerParams, seed: int) -> list[int]:
    """Ends of the chunks of data; none for no data."""
    n = len(data)
    if not n:
        return []
    hard_mask, easy_mask = params.masks
    width = params.bits + 2
    gear = (np.array(gear_table(seed), np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    g = gear[np.frombuffer(data, np.uint8)]
    h, span = g.copy(), 1
    while span < width:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span) if span < n else h[:0]
        h, span = longer, 2 * span
    hard = np.flatnonzero((h & np.uint32(hard_mask)) == 0)
    easy = np.flatnonzero((h & np.uint32(easy_mask)) == 0)
    ends, start = [], 0
    while start < n:
        end = _next(start, n - start, params, g, hard, easy, width)
        ends.append(end)
        start = end
    return ends


def _next(start: int, n: int, p: ChunkerParams, g: np.ndarray, hard: np.ndarray, easy: np.ndarray, width: int) -> int:
    if n <= p.min_size:
        return start + n
    limit = min(n, p.max_size)
    normal = min(p.avg_size, limit)
    hard_mask, easy_mask = p.masks
    settled = min(p.min_size + width - 1, limit)
    h = 0
    for i, value in enumerate(g[start + p.min_size : start + settled].tolist(), p.min_size):
        h = ((h << 1) + value) & 0xFFFFFFFF
        if not h & (hard_mask if i < normal else easy_mask):
            return start + i + 1
    for at, low, high in ((hard, settled, normal), (easy, max(settled, normal), limit)):
        k = int(np.searchsorted(at, start + low))
        if k < len(at) and at[k] < start + high:
            return int(at[k]) + 1
    return start + limit


def chunks(data: bytes, params: ChunkerParams, seed: int) -> Iterator[bytes]:
    start = 0
    for end in cut_points(data, params, seed):
        yield data[start:end]
        start = end


def cdc_chunks(files: DataFrame, avg: int, seed: int, data: bool = True, hashed: bool = True, level: int | None = None) -> DataFrame:
    """(name, idx, offset, len[, chunk_id][, data]) of files(name, content).

    A null content is empty and has no chunks. Nothing is shuffled; a file's rows
    are emitted in bounded batches. With a level, data is compressed where that makes it shorter.
    """
    params = ChunkerParams.from_avg(avg)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        if level is not None:
            import zstandard

            packer = zstandard.ZstdCompressor(level=level)
        names, idx, offset, length, ids, bodies = [], [], [], [], [], []
        held = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(names, pa.string()), pa.array(idx, pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
            columns += [pa.array(ids, pa.string())] * hashed + [pa.array(bodies, pa.binary())] * data
            fields = ["name", "idx", "offset", "len"] + ["chunk_id"] * hashed + ["data"] * data
            return pa.RecordBatch.from_arrays(columns, names=fields)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                body, key = content.as_py() or b"", name.as_py()
                start = 0
                for k, end in enumerate(cut_points(body, params, seed)):
                    part = body[start:end]
                    names.append(key)
                    idx.append(k)
                    offset.append(start)
                    length.append(end - start)
                    if hashed:
                        ids.append(hashlib.sha256(part).hexdigest())
                    if data:
                        bodies.append(part if packer is None else min(part, packer.compress(part), key=len))
                    held += end - start if data else 100
                    start = end
                    if held > 1 << 24:
                        yield out()
                        for column in (names, idx, offset, length, ids, bodies):
                            column.clear()
                        held = 0
        if names:
            yield out()

    schema = "name string, idx long, offset long, len long" + ", chunk_id string" * hashed + ", data binary" * data
    return files.select("name", "content").mapInArrow(split, schema)


def unpacked(rows: DataFrame) -> DataFrame:
    """rows (with packed and len) with their data: what is shorter than len was compressed. Data that isn't len bytes long fails the query."""
    names = [c for c in rows.columns if c not in ("packed", "data")]
    at = names.index("len")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[bytes] = []
            for n, body in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if len(body) < n:
                    try:
                        body = unpacker.decompress(body, max_output_size=CHUNK_LIMIT)
                    except zstandard.ZstdError as e:
                        raise ValueError("a chunk doesn't open: corrupted bytes") from e
                if len(body) != n:
                    raise ValueError("a chunk has another length than its manifest says")
                out.append(body)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.binary())], names=[*names, "data"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "packed").mapInArrow(unpack, f"{kept}, data binary")
