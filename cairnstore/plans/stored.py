"""Registered queries over a store that is really written: puts, removals, checkpoints, a compaction, a mirror, streams.

Documents are put by thirds: the first, then the second; the first is removed again and
its volume compacted; the third is put, documents labelled toxic are removed, and pages
are put. With a checkpoint every third record the log is delta, delta, checkpoint,
compact, delta, checkpoint, delta.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Files
from ..functions import sealing
from ..operators import chunked
from ..sources import datasource, tables
from ..store import Config, Gates, Store, Volume
from ..streaming import ingest
from . import oracles
from .scenario import AVG

KEYS = sealing.Keys(bytes(range(64, 96)))
VOLUMES = tuple(Volume(v, threshold=t) for v, t in oracles.STORE_VOLUMES)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_made: dict[tuple[str, str, bool], tuple[str, list]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _root(spark: SparkSession) -> str:
    return f"{tables.shared_dir(spark)}/stores/{uuid.uuid4().hex}"


def _third(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return tables.documents(spark, sf_dir).where(F.col("put_ord") % 3 == k).select("name", "content")


def _names(rows: DataFrame) -> list[str]:
    return [r["name"] for r in rows.select("name").distinct().collect()]


def store(spark: SparkSession, sf_dir: str, sealed: bool) -> tuple[Store, list]:
    """The store of this session over these tables, made once, and what its puts reported."""
    at = (spark.sparkContext.applicationId, sf_dir, sealed)
    keys = KEYS if sealed else None
    if at not in _made:
        root = _root(spark)
        s = Store.init(spark, root, keys, Config(avg_size=AVG, checkpoint_interval=3, volumes=VOLUMES, sealed=sealed))
        done = [s.put_batch(_third(spark, sf_dir, 0)), s.put_batch(_third(spark, sf_dir, 1))]
        s.remove(*_names(_third(spark, sf_dir, 0)))
        s.compact(Gates(), force=True)
        done.append(s.put_batch(_third(spark, sf_dir, 2)))
        toxic = tables.table(spark, sf_dir, "labels").where("toxic = 1 AND doc_id % 3 <> 0")
        alive = tables.documents(spark, sf_dir).join(toxic.select(F.col("doc_id").alias("put_ord")), "put_ord", "left_semi")
        s.remove(*_names(alive))
        done.append(s.put_batch(tables.pages(spark, sf_dir)))
        _made[at] = root, done
    root, done = _made[at]
    return Store(spark, root, keys), done


def _contents(s: Store, at: int | None = None) -> DataFrame:
    """(name, file_hash) of what a store gives back: chunks found, opened, checked and put together."""
    whole = chunked.reassembled(s.namespace(at), s.read(at=at))
    return whole.select("name", F.sha2("content", 256).alias("file_hash"))


@query
def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, True)[0].log().select("version", "kind")


@query
def store_put_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, d.total_chunks, d.new_chunks, d.deduped, d.new_bytes, d.size) for k, d in enumerate(store(spark, sf_dir, False)[1])]
    return spark.createDataFrame(rows, "put long, total_chunks long, new_chunks long, deduped long, new_bytes long, size long")


@query
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(store(spark, sf_dir, True)[0])


@query
def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version's listing through the data source: checkpoints, and the records after them."""
    datasource.register(spark)
    s = store(spark, sf_dir, False)[0]
    read = spark.read.format("blobstore").option("share", 1 << 16)
    out = None
    for v in range(s.tip() + 1):
        one = read.option("versionAsOf", v).load(s.files.root).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
        one = one.select(F.lit(v).cast("long").alias("version"), "n_files", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


@query
def store_snapshots_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir, True)[0]
    out = None
    for v in range(s.tip() + 1):
        one = s.ls(v).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
        one = one.select(F.lit(v).cast("long").alias("version"), "n_files", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


@query
def store_seg_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the segments that the log's seals and retirements leave, by volume."""
    index = store(spark, sf_dir, False)[0].seg_index()
    return index.groupBy("vol").agg(F.sum("bytes").alias("bytes"))


@query
def store_segment_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, False)[0].segment_listing().select("path", "bytes").distinct()


@query
def store_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mirror of the store gives back."""
    s, target = store(spark, sf_dir, True)[0], _root(spark)
    s.mirror(target, {v.id: target for v in VOLUMES})
    return _contents(Store(spark, target, KEYS))


@query
def store_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store tells apart: a batch done before, a lost race for a version, an unchanged put, a second init."""
    root = _root(spark)
    s = Store.init(spark, root, KEYS, Config(avg_size=AVG, volumes=VOLUMES, sealed=True))
    batch = _third(spark, sf_dir, 0)
    first, again = s.put_batch(batch, token="t"), s.put_batch(batch, token="t")
    same = s.put_batch(batch)
    files = Files(spark, root)
    won = files.create("log/00000000000000000001.json", b"x"), files.create("log/00000000000000000001.json", b"y")
    files.delete("log/00000000000000000001.json")
    try:
        Store.init(spark, root, KEYS)
        refused = False
    except Exception:
        refused = True
    rows = [("first", first.committed), ("again", again.committed), ("same", same.committed), ("won", won[0]), ("lost", won[1]), ("second init refused", refused)]
    return spark.createDataFrame(rows, "what string, yes boolean")


@query
def store_orphans_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A put that dies before its commit leaves a segment that a sweep removes, and nothing else."""

    class Stop(Exception):
        pass

    def stop(at: str) -> None:
        if at == "before-cas":
            raise Stop

    root = _root(spark)
    s = Store.init(spark, root, KEYS, Config(avg_size=AVG, volumes=VOLUMES, sealed=True))
    s.put_batch(_third(spark, sf_dir, 0))
    try:
        Store(spark, root, KEYS, hook=stop).put_batch(_third(spark, sf_dir, 1))
    except Stop:
        swept = s.compact(Gates(orphan_window=0))["orphans_swept"]
    return _contents(s).select("name", "file_hash", F.lit(swept).cast("long").alias("swept"))


@query
def store_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files, each micro-batch one transaction; the listing afterwards."""
    landing = _root(spark)
    _third(spark, sf_dir, 1).repartition(3, "name").write.parquet(landing)
    root = _root(spark)
    s = Store.init(spark, root, None, Config(avg_size=AVG, volumes=VOLUMES, sealed=False))
    stream = spark.readStream.schema("name string, content binary").option("maxFilesPerTrigger", 1).parquet(landing)
    ingest.ingest(stream, s, f"{root}-check", f"ingest-{uuid.uuid4().hex}", once=True).awaitTermination()
    return s.namespace().select("name", "size", "file_hash")


@query
def store_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream reads it."""
    datasource.register(spark)
    s = store(spark, sf_dir, False)[0]
    rows = spark.readStream.format("blobstore").option("tail", "true").load(s.files.root)
    name = f"tail_{uuid.uuid4().hex}"
    q = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{_root(spark)}-check").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).select("version", "kind")


@query
def store_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's settings as they are read back, and its volumes."""
    s = store(spark, sf_dir, True)[0]
    c = s.config
    rows = [(c.avg_size, c.zstd_level, c.checkpoint_interval, c.sealed, k, v.id, v.threshold, v.id == s.spare()) for k, v in enumerate(c.volumes)]
    kind = "avg_size long, zstd_level long, checkpoint_interval long, sealed boolean, ord long, volume string, threshold long, spare boolean"
    return spark.createDataFrame(rows, kind)
