"""Operators of compaction, sweeping and mirroring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_set(refs: DataFrame) -> DataFrame:
    """(vol, n, bytes): distinct live chunks of each volume."""
    one = refs.select("vol", "id", "clen").dropDuplicates(["vol", "id"])
    return one.groupBy("vol").agg(F.count(F.lit(1)).alias("n"), F.sum("clen").alias("bytes"))


def files_touching(manifests: DataFrame) -> DataFrame:
    """(vol, name) for manifests(name, chunks): the volumes of a file's chunks, read off the nested array."""
    return manifests.select("name", F.explode(F.array_distinct(F.transform("chunks", lambda c: c["vol"]))).alias("vol")).select("vol", "name")


def segment_ids(refs: DataFrame) -> DataFrame:
    """(vol, seg): the segment that a volume's compaction writes, by what it holds, so that a repeat finds it written.

    A volume's ids are hashed in groups by their first four digits and the groups'
    digests once more, so no task holds all ids of a volume.
    """
    ids = refs.select("vol", "id").distinct()
    grouped = ids.groupBy("vol", F.substring("id", 1, 4).alias("g")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    digests = grouped.select("vol", "g", F.sha2(F.array_join("ids", "\n"), 256).alias("d"))
    whole = digests.groupBy("vol").agg(F.array_sort(F.collect_list(F.struct("g", "d"))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: x["d"]), "\n")
    return whole.select("vol", F.substring(F.sha2(F.concat_ws("\n", F.lit("compact"), "vol", joined), 256), 1, 32).alias("seg"))


def rewrite(refs: DataFrame, chunk_store: DataFrame, destinations: DataFrame) -> DataFrame:
    """(dest, seg, chunk_id, clen, ...): the live chunks of every volume with a destination, as they are written there."""
    ids = refs.select("vol", "id").distinct()
    moved = ids.join(F.broadcast(destinations.where("dest is not null")), "vol").join(F.broadcast(segment_ids(refs)), "vol")
    stored = chunk_store.withColumnsRenamed({"vol": "_vol", "seg": "_seg"})
    hit = (F.col("vol") == F.col("_vol")) & (F.col("id") == F.col("chunk_id"))
    kept = [c for c in chunk_store.columns if c not in ("vol", "seg", "chunk_id")]
    return moved.join(stored, hit).select("dest", "seg", "chunk_id", *kept).dropDuplicates(["dest", "seg", "chunk_id"])


def repointed(manifests: DataFrame, source: str, dest: str, seg: str) -> DataFrame:
    """Manifests whose chunks on source point to where they were moved."""
    def move(c):
        return F.when(c["vol"] == source, c.withField("vol", F.lit(dest)).withField("seg", F.lit(seg))).otherwise(c)

    touched = F.exists("chunks", lambda c: c["vol"] == source)
    return manifests.where(touched).withColumn("chunks", F.transform("chunks", move))


def conflicts(refs: DataFrame, moved: DataFrame) -> DataFrame:
    """(vol, conflict): whether a live chunk of the volume isn't among moved(vol, id)."""
    missing = refs.select("vol", "id").distinct().join(moved, ["vol", "id"], "left_anti").select("vol").distinct()
    volumes = moved.select("vol").distinct()
    return volumes.join(missing.withColumn("_hit", F.lit(True)), "vol", "left").select("vol", F.coalesce("_hit", F.lit(False)).alias("conflict"))


def orphans(segments: DataFrame, refs: DataFrame, now: int, window: int) -> DataFrame:
    """(vol, seg) of segments(vol, seg, ts) that nothing refers to and that are older than the window."""
    old = segments.where(F.lit(now) - F.col("ts") >= window)
    return old.join(refs.select("vol", "seg").distinct(), ["vol", "seg"], "left_anti").select("vol", "seg")


def dangling(refs: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """References whose chunk isn't where they say."""
    stored = chunk_store.select("vol", "seg", F.col("chunk_id").alias("id")).distinct()
    return refs.join(stored, ["vol", "seg", "id"], "left_anti").select("name", "idx", "id", "vol", "seg")


def missing_targets(volumes: DataFrame, targets: DataFrame) -> DataFrame:
    return volumes.select(F.col("id").alias("vol")).join(targets.select("vol"), "vol", "left_anti")


def mirror_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(kind, path) still to be copied, for listings (kind, path); nothing is ever deleted at the target."""
    return source.join(target, ["kind", "path"], "left_anti").select("kind", "path")
