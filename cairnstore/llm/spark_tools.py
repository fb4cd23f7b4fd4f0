"""Shared Spark helpers: tables in the shared folder, dense row numbers, connected components."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet (with the writer's options) under the shared folder and read it back.

    The table outlives the call, since the result is lazy; what the folder holds
    goes when the cluster cleans it (drop() removes one table sooner).
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no lazy result needs any more."""
    jvm = table.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table._table_path)
    path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a side that was counted and is within the limit; beyond it the planner's own join."""
    return F.broadcast(df) if rows <= limit else df


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """Dense numbers from 0 in a total order, without a single-partition window.

    Rows are range-partitioned and sorted, written once (so that a lost executor
    can't change the ranges between two reads), counted by partition, and each
    partition's numbers start where the one before it ends. Only one count per
    partition reaches the driver. Equal rows get adjacent numbers, nulls come first.
    Returns the numbered rows and their total.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kept = materialize(dealt.withColumn("_mono", F.monotonically_increasing_id()))
    part = F.shiftright("_mono", 33)
    counts = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    bases = list(itertools.accumulate((n for _, n in counts), initial=0))
    if not counts:
        return kept.withColumn(name, F.lit(0).cast("long")).drop("_mono"), 0
    values = ", ".join(f"({p}L, {b}L)" for (p, _), b in zip(counts, bases, strict=False))
    base = spark.sql(f"SELECT * FROM VALUES {values} AS t(_part, _base)")
    numbered = kept.withColumn("_part", part).join(F.broadcast(base), "_part")
    number = F.col("_base") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, number).drop("_mono", "_part", "_base"), bases[-1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component), component the smallest node of each.

    Alternates the large-star and small-star steps until nothing changes; the
    number of rounds grows with the logarithm of a component's size, whatever its
    shape. Only counts and checksums reach the driver. Each round is written to
    the shared folder. A node's rows are pre-aggregated before the shuffle, and a
    hub's rows meet one row, so that a skewed join can split them. Loops and
    repeated edges are fine, edges with a null end are ignored, and nodes that
    have loops only don't appear.
    """
    x, y = F.col(a), F.col(b)
    stars = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    before = _checksum(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        following = materialize(small)
        drop(stars)
        stars, after = following, _checksum(following)
        if after == before:
            break
        before = after
    ends = stars.select("v").distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        ends.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def _checksum(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(mixed, 20)), F.sum(mixed.bitwiseAND(F.lit(0xFFFFF)))).first()
    return tuple(row)
