"""Operators on the transaction log: replay, history, checkpoints.

The log is (version, ts, kind, name, action, sz): one row per file action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import numbered


def namespace_at(log: DataFrame, version: int | None = None) -> DataFrame:
    """(name, version, sz) of the names alive at a version: the last action of each wins, a removal over a put of one version.

    Pre-aggregated by name, so a name with a long history is no hot task.
    """
    upto = log if version is None else log.where(F.col("version") <= version)
    last = F.max(F.struct("version", (F.col("action") == "remove").alias("gone"), "sz")).alias("last")
    state = upto.where("name is not null").groupBy("name").agg(last).where(~F.col("last.gone"))
    return state.select("name", F.col("last.version").alias("version"), F.col("last.sz").alias("sz"))


def snapshots(log: DataFrame, pins: list[int]) -> DataFrame:
    """(pin, n_files, bytes) at several versions, in one pass over the log."""
    pinned = log.where("name is not null").select("*", F.explode(F.array(*[F.lit(p).cast("long") for p in pins])).alias("pin"))
    last = F.max(F.struct("version", (F.col("action") == "remove").alias("gone"), "sz")).alias("last")
    state = pinned.where("version <= pin").groupBy("pin", "name").agg(last).where(~F.col("last.gone"))
    return state.groupBy("pin").agg(F.count(F.lit(1)).alias("n_files"), F.sum("last.sz").alias("bytes"))


def validity(log: DataFrame) -> DataFrame:
    """(name, version, valid_to, action): each action holds up to the next of its name."""
    following = Window.partitionBy("name").orderBy("version")
    return log.where("name is not null").select("name", "version", F.lead("version").over(following).alias("valid_to"), "action")


def checkpoints(log: DataFrame) -> DataFrame:
    """(version, tail_len): every checkpoint and how many records follow it before the next one or the tip.

    Checkpoints are numbered by ranges, and each meets the next by number, so no task sees all of them.
    """
    versions = log.groupBy("version").agg(F.max((F.col("kind") == "checkpoint").cast("int")).alias("is_checkpoint"))
    marks = numbered(versions.where("is_checkpoint = 1").select("version"), ["version"], "_n")
    tip = versions.agg(F.max("version")).first()[0]
    following = marks.select((F.col("_n") - 1).alias("_n"), F.col("version").alias("next"))
    return marks.join(following, "_n", "left").select("version", (F.coalesce(F.col("next") - 1, F.lit(tip)) - F.col("version")).alias("tail_len"))


def kinds(log: DataFrame) -> DataFrame:
    """(kind, n): checkpoints against all other records."""
    kind = F.when(F.col("kind") == "checkpoint", "checkpoint").otherwise("other")
    return log.select("version", kind.alias("kind")).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def compactions(log: DataFrame) -> DataFrame:
    return log.where("kind = 'compact'").agg(F.count_distinct("version").alias("n"))


def last_compaction(log: DataFrame) -> DataFrame:
    return log.where("kind = 'compact'").agg(F.max("ts").alias("ts"))
