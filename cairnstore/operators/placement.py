"""Operators of placement: usage, liveness, choice of volumes, gates.

volumes is (ord, id, threshold, spare); refs is (name, idx, id, clen, vol, seg) of
the live namespace; seg_index is (vol, seg, bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def used(volumes: DataFrame, seg_index: DataFrame) -> DataFrame:
    total = seg_index.groupBy("vol").agg(F.sum("bytes").alias("bytes"))
    return volumes.join(total, volumes["id"] == total["vol"], "left").select(F.col("id").alias("vol"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def live(refs: DataFrame) -> DataFrame:
    """(vol, live): bytes of distinct live chunks; a chunk counts where its first reference in (name, idx) order is."""
    owner = refs.groupBy("id").agg(F.min(F.struct("name", "idx", "vol", "clen")).alias("o"))
    return owner.groupBy(F.col("o.vol").alias("vol")).agg(F.sum("o.clen").alias("live"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole == 0, F.lit(1)).otherwise(whole))


def volume_stats(volumes: DataFrame, seg_index: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, total, live, dead, threshold, spare, dead_ratio, utilization) of every volume, from metadata alone."""
    alive = live(refs).withColumnRenamed("vol", "_v")
    both = volumes.join(used(volumes, seg_index), F.col("id") == F.col("vol")).join(alive, F.col("id") == F.col("_v"), "left")
    both = both.withColumn("live", F.coalesce("live", F.lit(0))).withColumnRenamed("bytes", "total")
    both = both.withColumn("dead", F.greatest(F.col("total") - F.col("live"), F.lit(0)))
    return both.select(
        "id",
        "total",
        "live",
        "dead",
        "threshold",
        "spare",
        ratio(F.col("dead"), F.col("total")).alias("dead_ratio"),
        ratio(F.col("total"), F.col("threshold")).alias("utilization"),
        "ord",
    )


def fitting(volumes: DataFrame, usage: DataFrame, wanted: DataFrame, projected: str) -> DataFrame:
    """wanted joined to the volumes that have room for it, with their headroom."""
    room = volumes.join(usage, F.col("id") == F.col("vol")).select("ord", "id", "spare", "threshold", (F.col("threshold") - F.col("bytes")).alias("headroom"))
    return wanted.join(F.broadcast(room), F.col(projected) <= F.col("headroom"), "inner")


def select_volume(volumes: DataFrame, usage: DataFrame, wanted: DataFrame) -> DataFrame:
    """(projected, vol): the writable volume with the most headroom, the first declared of equals; null at the budget wall."""
    fit = fitting(volumes, usage, wanted, "projected").where(~F.col("spare"))
    best = fit.groupBy("projected").agg(F.min(F.struct(-F.col("headroom"), "ord", "id")).alias("best"))
    return wanted.join(best, "projected", "left").select("projected", F.col("best.id").alias("vol"))


def select_destination(volumes: DataFrame, usage: DataFrame, moved: DataFrame) -> DataFrame:
    """(vol, dest) for moved(vol, bytes): the spare if it fits, else the roomiest other volume, else null."""
    wanted = moved.select(F.col("vol").alias("source"), F.col("bytes").alias("projected"))
    fit = fitting(volumes, usage, wanted, "projected").where(F.col("id") != F.col("source"))
    best = fit.groupBy("source").agg(F.min(F.struct((~F.col("spare")).alias("later"), -F.col("headroom"), "ord", "id")).alias("best"))
    return wanted.join(best, "source", "left").select(F.col("source").alias("vol"), F.col("best.id").alias("dest"))


def placement_plan(puts: DataFrame, budgets: list[tuple[str, int]]) -> DataFrame:
    """(put_ord, bytes, vol) of puts(put_ord, bytes), each placed after the ones before it.

    Every choice depends on all earlier ones, so this is one fold over the put order,
    in one task that streams two numbers for each put and keeps one for each volume.
    budgets: writable volumes in declared order with their thresholds.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = [threshold for _, threshold in budgets]
        for batch in batches:
            out = []
            for size in batch.column(1).to_pylist():
                best = max(range(len(room)), key=lambda k: (room[k], -k), default=None)
                if best is None or room[best] < size:
                    out.append(None)
                else:
                    room[best] -= size
                    out.append(budgets[best][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["put_ord", "bytes", "vol"])

    ordered = puts.select("put_ord", "bytes").repartition(1).sortWithinPartitions("put_ord")
    return ordered.mapInArrow(fold, "put_ord long, bytes long, vol string")


def gates(stats: DataFrame, last: DataFrame, settings: DataFrame, now: Column) -> DataFrame:
    """Gates of compaction for each of settings(pressure, min_interval, force).

    Pressure: any volume but the spare at or above the gate. Interval: none before, or long enough ago. Force
    opens both but no dead-ratio gate.
    """
    most = stats.where(~F.col("spare")).agg(F.max("utilization").alias("_most"))
    both = settings.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(last.select(F.col("ts").alias("_last"))))
    pressed = F.coalesce(F.col("_most") >= F.col("pressure"), F.lit(False))
    rested = F.coalesce(now - F.col("_last") >= F.col("min_interval"), F.lit(True))
    return both.select(
        "pressure",
        "min_interval",
        pressed.alias("under_pressure"),
        rested.alias("interval_ok"),
        "force",
        (F.col("force") | (pressed & rested)).alias("open"),
    )


def candidates(stats: DataFrame, dead_gate: float) -> DataFrame:
    return stats.where(~F.col("spare") & (F.col("total") > 0) & (F.col("dead_ratio") > dead_gate)).select(F.col("id").alias("vol"), "dead_ratio")
