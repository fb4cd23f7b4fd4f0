"""Operators on chunks: offsets, dedup, reassembly, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_slices(files: DataFrame, size: int) -> DataFrame:
    """(name, idx, len, chunk_id) of equal slices of files(name, content); an empty file has none."""
    parts = F.ceil(F.octet_length("content") / size).cast("int")
    spread = files.where(F.octet_length("content") > 0).select(
        "*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("i")
    )
    data = F.substring("content", F.col("i") * size + 1, F.lit(size))
    kept = [c for c in files.columns if c != "content"]
    return spread.select(*kept, F.col("i").cast("long").alias("idx"), F.octet_length(data).cast("long").alias("len"), F.sha2(data, 256).alias("chunk_id"))


def offsets(chunks: DataFrame) -> DataFrame:
    before = Window.partitionBy("name").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select("name", "idx", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("offset"), "len")


def first_places(chunks: DataFrame, order: list[str]) -> DataFrame:
    """(chunk_id, len, first): where each chunk occurs first in the given order. Pre-aggregated, so a hot chunk is no hot task."""
    return chunks.groupBy("chunk_id").agg(F.min(F.struct(*order)).alias("first"), F.min("len").alias("len"))


def put_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """What putting each file would report, in name order: a chunk is new where it occurs first.

    chunks: (name, idx, len, chunk_id). Files without chunks are reported with zeros.
    """
    sizes = files.select("name", F.octet_length("content").cast("long").alias("size"))
    total = chunks.groupBy("name").agg(F.count(F.lit(1)).alias("total_chunks"))
    first = first_places(chunks, ["name", "idx"])
    new = first.groupBy(F.col("first.name").alias("name")).agg(F.count(F.lit(1)).alias("new_chunks"), F.sum("len").alias("new_bytes"))
    out = sizes.join(total, "name", "left").join(new, "name", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total_chunks", "new_chunks", "new_bytes")}
    out = out.withColumns(zero)
    return out.select("name", "total_chunks", "new_chunks", (F.col("total_chunks") - F.col("new_chunks")).alias("deduped"), "new_bytes", "size")


def dedup_ratio(chunks: DataFrame) -> DataFrame:
    each = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("all"), F.min("len").alias("one"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("distinct_chunks"),
        F.coalesce(F.sum("all"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("one"), F.lit(0)).alias("distinct_bytes"),
    )


def reassembled(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, content) of every file from its chunks (with data). A whole file is one value, of 2 GB at most."""
    whole = chunks.groupBy("name").agg(F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY idx)").alias("_content"))
    out = files.select("name").join(whole, "name", "left")
    return out.select("name", F.coalesce("_content", F.lit(b"")).alias("content"))


def verified(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, ok): every chunk hashes to its id, indices are gapless and lengths make up the file."""
    each = chunks.groupBy("name").agg(
        F.bool_and((F.sha2("data", 256) == F.col("chunk_id")) & (F.octet_length("data") == F.col("len"))).alias("_good"),
        F.sum("len").alias("_bytes"),
        F.count(F.lit(1)).alias("_n"),
        F.max("idx").alias("_last"),
    )
    out = files.select("name", F.octet_length("content").cast("long").alias("_size")).join(each, "name", "left")
    whole = F.col("_good") & (F.col("_bytes") == F.col("_size")) & (F.col("_last") + 1 == F.col("_n"))
    return out.select("name", F.coalesce(whole, F.col("_size") == 0).alias("ok"))
