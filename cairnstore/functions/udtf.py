"""Chunking as a table function: SELECT f.name, c.* FROM files f, LATERAL cdc(f.content, 65536, 42) c.

Spark 4.1 takes no Arrow table function in a lateral join, so this one gets a row at a
time, a whole file each; DataFrames are cut by chunking.cdc_chunks in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .chunking import ChunkerParams, cut_points


@udtf(returnType="idx bigint, offset bigint, len bigint, chunk_id string")
class Cdc:
    def eval(self, content: bytes, avg: int, seed: int) -> Iterator[tuple[int, int, int, str]]:
        body, start = bytes(content or b""), 0
        for idx, end in enumerate(cut_points(body, ChunkerParams.from_avg(avg), seed)):
            yield idx, start, end - start, hashlib.sha256(body[start:end]).hexdigest()
            start = end


def register(spark: SparkSession) -> None:
    spark.udtf.register("cdc", Cdc)
