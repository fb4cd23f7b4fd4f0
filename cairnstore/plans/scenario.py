"""The store that the placement and compaction queries look at.

Every document is put in order of doc_id, in slices of one KiB; a put's new slices
become one segment on the volume that the placement chooses; documents labelled
toxic are removed afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunked, placement
from ..sources import tables

MIB = 1 << 20
VOLUMES = (("v0", 64 * MIB, False), ("v1", 64 * MIB - (64 << 10), False), ("v2", 64 * MIB - (96 << 10), False), ("v3", 128 * MIB, True))
AVG, SEED = 1 << 10, 42


def volumes(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({k}L, '{v}', {t}L, {str(s).lower()})" for k, (v, t, s) in enumerate(VOLUMES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ord, id, threshold, spare)")


@dataclass
class Scenario:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def files(self) -> DataFrame:
        return tables.documents(self.spark, self.sf_dir)

    @cached_property
    def volumes(self) -> DataFrame:
        return volumes(self.spark)

    @cached_property
    def slices(self) -> DataFrame:
        return tables.written(chunked.fixed_slices(self.files, tables.SLICE))

    @cached_property
    def first(self) -> DataFrame:
        return chunked.first_places(self.slices, ["put_ord", "idx"])

    @cached_property
    def puts(self) -> DataFrame:
        return self.first.groupBy(F.col("first.put_ord").alias("put_ord")).agg(F.sum("len").alias("bytes"))

    @cached_property
    def plan(self) -> DataFrame:
        return tables.written(placement.placement_plan(self.puts, [(v, t) for v, t, spare in VOLUMES if not spare]))

    @staticmethod
    def seg(put_ord: str = "put_ord"):
        return F.concat(F.lit("s"), F.lpad(F.col(put_ord).cast("string"), 9, "0"))

    @cached_property
    def segments(self) -> DataFrame:
        """(vol, seg, put_ord, bytes)"""
        return self.plan.where("vol is not null").select("vol", self.seg().alias("seg"), "put_ord", "bytes")

    @cached_property
    def seg_index(self) -> DataFrame:
        return self.segments.select("vol", "seg", "bytes")

    @cached_property
    def chunk_store(self) -> DataFrame:
        """(vol, seg, chunk_id, clen)"""
        placed = self.first.select("chunk_id", F.col("first.put_ord").alias("put_ord"), F.col("len").alias("clen"))
        return placed.join(self.segments, "put_ord").select("vol", "seg", "chunk_id", "clen")

    @cached_property
    def refs(self) -> DataFrame:
        """(name, idx, id, len, clen, vol, seg) of every document"""
        placed = self.chunk_store.withColumnRenamed("chunk_id", "id")
        return self.slices.withColumnRenamed("chunk_id", "id").join(placed, "id").select("name", "idx", "id", "len", "clen", "vol", "seg")

    @cached_property
    def live(self) -> DataFrame:
        toxic = tables.table(self.spark, self.sf_dir, "labels").where("toxic = 1")
        gone = toxic.select(tables.file_name("doc", F.col("doc_id")).alias("name")).distinct()
        return tables.written(self.refs.join(gone, "name", "left_anti"))

    @cached_property
    def manifests(self) -> DataFrame:
        """(name, chunks) of the live documents"""
        ref = F.struct("idx", "id", "len", "clen", "vol", "seg")
        return self.live.groupBy("name").agg(F.array_sort(F.collect_list(ref)).alias("chunks"))

    @cached_property
    def stats(self) -> DataFrame:
        return placement.volume_stats(self.volumes, self.seg_index, self.live)

    @cached_property
    def destinations(self) -> DataFrame:
        moved = placement_moved(self.live)
        return placement.select_destination(self.volumes, placement.used(self.volumes, self.seg_index), moved)


def placement_moved(refs: DataFrame) -> DataFrame:
    one = refs.select("vol", "id", "clen").dropDuplicates(["vol", "id"])
    return one.groupBy("vol").agg(F.sum("clen").alias("bytes"))
