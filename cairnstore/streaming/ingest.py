"""Streams of files into a store, each micro-batch one transaction, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import Store


def folder(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of files(name, content, modified, path) that appear in a folder; a name is its path's last part."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", per_trigger).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("modificationTime").alias("modified"), "path")


def last_of_each(files: DataFrame) -> DataFrame:
    """files(name, content), each name once: the last content by the other columns in their order, then by its hash."""
    order = F.struct(*[c for c in files.columns if c not in ("name", "content")], F.sha2("content", 256).alias("_hash"))
    return files.groupBy("name").agg(F.max_by("content", order).alias("content"))


def ingest(files: DataFrame, store: Store, checkpoint: str, name: str, once: bool = False) -> StreamingQuery:
    """Put every micro-batch of files. A batch that was committed before a failure is recognised by its token.

    Of several contents of one name within a batch the last one is put, by modification
    time and path from a folder, so that a batch done again puts the same.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.put_batch(last_of_each(batch), token=f"{name}-{number}")

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
