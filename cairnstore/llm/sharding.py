"""Sharding by a Feistel permutation of global row numbers.

Rows get dense numbers in a total order; a keyed Feistel network over the
smallest even-bit domain that holds them, walked along its cycle until it lands
inside, permutes the numbers. Position modulo shard count is the shard, position
divided by it the slot, so both can be computed from a row number and back, and
shard sizes differ by one row at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_tools import row_numbers
from .wordhash import mix

ROUNDS = 6


def _round_keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        start = np.uint64(seed % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(start + np.arange(1, ROUNDS + 1, dtype=np.uint64))


def _half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _pass(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (mix(right + key) & mask)
    return (left << shift) | right


def _unpass(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> shift, x & mask
    for key in keys[::-1]:
        left, right = right ^ (mix(left + key) & mask), left
    return (left << shift) | right


def _walk(x: np.ndarray, n: int, step, seed: int) -> np.ndarray:
    half, keys = _half_bits(n), _round_keys(seed)
    with np.errstate(over="ignore"):
        out = step(np.asarray(x, np.uint64), half, keys)
        outside = np.flatnonzero(out >= np.uint64(n))
        while len(outside):
            out[outside] = step(out[outside], half, keys)
            outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of row numbers below n under the seed's permutation of range(n)."""
    return _walk(numbers, n, _pass, seed)


def invert(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers at the positions: permute() undone."""
    return _walk(positions, n, _unpass, seed)


def shard(df: DataFrame, shards: int, order: list[Column], seed: int = 0) -> DataFrame:
    """df with row_number, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    order should identify rows; rows equal in it get adjacent numbers in any
    order. Nulls in order sort first and are rows like any other. An empty table
    gives an empty result. Columns of df named row_number, shard or slot are
    replaced. Only the range partitioning of df's own columns is shuffled.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    numbered, n = row_numbers(df.drop("row_number", "shard", "slot"), order)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(batch.schema.get_field_index("row_number")).to_numpy(zero_copy_only=False)
            at = permute(number, n, seed)
            added = [pa.array((at % shards).astype(np.int32)), pa.array(at // shards)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "shard", "slot"])

    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return numbered.mapInArrow(place, f"{kept}, shard int, slot long")


def shard_documents(documents: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """Digest rows of documents with their shard and slot; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard(rows, shards, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
