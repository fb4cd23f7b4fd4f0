"""The store's relations derived from the driver's tables.

Documents and pages are files; documents are put one after the other by doc_id;
events, in order of time, are a log of puts and removals.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import CHECKPOINT_INTERVAL

SLICE = 1 << 10
#: A compaction every so many versions, half-way between; it never falls on a checkpoint's version.
COMPACT_EVERY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table dealt to all cores if its files are fewer: a row group is read by one task, whatever its size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def file_name(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.lpad(number.cast("string"), 9, "0"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(name, content, put_ord), one for each document."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(file_name("doc", F.col("doc_id")).alias("name"), content.alias("content"), F.col("doc_id").alias("put_ord"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce("html", F.lit("")).cast("binary")
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(file_name("page", F.col("page_id")).alias("name"), content.alias("content"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cairnstore-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df, written once under the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with dense numbers in a total order, by range partitions and their counts: no task sees all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = written(dealt.withColumn("_mono", F.monotonically_increasing_id()))
    part = F.shiftright("_mono", 33)
    counts = sorted(tuple(r) for r in kept.groupBy(part).count().collect())
    if not counts:
        return kept.withColumn(name, F.lit(start).cast("long")).drop("_mono")
    bases = list(itertools.accumulate((n for _, n in counts), initial=start))
    values = ", ".join(f"({p}L, {b}L)" for (p, _), b in zip(counts, bases, strict=False))
    base = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(_part, _base)"))
    out = kept.withColumn("_part", part).join(base, "_part")
    number = F.col("_base") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, number).drop("_mono", "_part", "_base")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log(version, ts, kind, name, action, sz): an error removes a user's file, any other event puts it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = numbered(events, ["ts", "event_id"], "version", start=1)
    kind = (
        F.when(F.col("version") % COMPACT_EVERY == COMPACT_EVERY // 2, "compact")
        .when(F.col("version") % CHECKPOINT_INTERVAL == 0, "checkpoint")
        .otherwise("delta")
    )
    return rows.select(
        "version",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        kind.alias("kind"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("event_type") == "error", "remove").otherwise("put").alias("action"),
        F.round(F.col("value") * 100).cast("long").alias("sz"),
    )
