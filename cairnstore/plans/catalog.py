"""Every registered query of the blob store, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, parsing, sealing
from ..operators import chunked, compaction, history, placement
from ..sources import tables
from . import oracles, stored
from .scenario import AVG, SEED, Scenario

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(stored.QUERIES)
ORACLE_SQL: dict[str, str] = oracles.SQL

#: Keys of the registered sealing queries; a store's own come from its keyfile.
KEYS = sealing.Keys(bytes(range(32)))
OTHER_KEYS = sealing.Keys(bytes(range(32, 64)))


def query(f: Query) -> Query:
    QUERIES[f.__name__.rstrip("_")] = f
    return f


def _cdc(spark: SparkSession, sf_dir: str, **what: bool) -> DataFrame:
    return chunking.cdc_chunks(tables.documents(spark, sf_dir), AVG, SEED, **what)


def _values(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


# Files and chunks


@query
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.documents(spark, sf_dir)
    return files.select("name", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("file_hash"))


@query
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select("name", F.sha2("content", 256).alias("file_hash"))


@query
def chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked.fixed_slices(tables.documents(spark, sf_dir), tables.SLICE).select("name", "idx", "chunk_id")


@query
def gear_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, g & oracles.GEAR_LOW) for i, g in enumerate(chunking.gear_table(SEED))]
    return spark.createDataFrame(rows, "i long, g long")


@query
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdc(spark, sf_dir, data=False, hashed=False).select("name", "idx", "len")


@query
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked.offsets(_cdc(spark, sf_dir, data=False, hashed=False))


@query
def put_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked.put_stats(tables.documents(spark, sf_dir), tables.written(_cdc(spark, sf_dir, data=False)))


@query
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked.dedup_ratio(_cdc(spark, sf_dir, data=False))


@query
def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = chunked.first_places(_cdc(spark, sf_dir, data=False), ["name", "idx"])
    return first.select("chunk_id", F.col("first.name").alias("first_name"), F.col("first.idx").alias("first_idx"), "len")


@query
def get_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.documents(spark, sf_dir)
    whole = chunked.reassembled(files, _cdc(spark, sf_dir, hashed=False))
    return whole.select("name", F.decode("content", "UTF-8").alias("content"))


@query
def verify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked.verified(tables.documents(spark, sf_dir), _cdc(spark, sf_dir))


@query
def noop_reputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is put again with its lines joined; a put of the same manifest commits nothing."""
    texts = tables.table(spark, sf_dir, "documents").select(tables.file_name("doc", F.col("doc_id")).alias("name"), F.coalesce("text", F.lit("")).alias("t"))
    old = texts.select("name", F.col("t").cast("binary").alias("content"))
    new = texts.select("name", F.replace("t", F.lit("\n"), F.lit(" ")).cast("binary").alias("content"))
    manifest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk_id"))), lambda c: c["chunk_id"]), ","), 256)
    each = [chunking.cdc_chunks(x, AVG, SEED, data=False).groupBy("name").agg(manifest.alias("m")) for x in (old, new)]
    both = old.select("name").join(each[0], "name", "left").join(each[1].withColumnRenamed("m", "again"), "name", "left")
    return both.select("name", (~F.col("m").eqNullSafe(F.col("again"))).alias("committed"))


# The chunk store


@query
def fanout_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = Scenario(spark, sf_dir).slices.select("chunk_id").distinct()
    return ids.select("chunk_id", parsing.fanout_path(F.col("chunk_id")).alias("path"))


@query
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scenario(spark, sf_dir)
    wanted = s.slices.select("chunk_id").distinct()
    return s.chunk_store.join(wanted, "chunk_id", "left_semi").select("vol", "seg", "chunk_id", "clen")


@query
def chunk_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scenario(spark, sf_dir)
    asked = chunked.fixed_slices(tables.pages(spark, sf_dir), tables.SLICE).select("chunk_id")
    asked = asked.unionByName(s.live.select(F.col("id").alias("chunk_id"))).distinct()
    have = s.chunk_store.select("chunk_id", F.lit(True).alias("_have"))
    return asked.join(have, "chunk_id", "left").select("chunk_id", F.coalesce("_have", F.lit(False)).alias("present"))


@query
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that break if volume v1 is lost."""
    s = Scenario(spark, sf_dir)
    return compaction.dangling(s.live, s.chunk_store.where("vol <> 'v1'"))


@query
def segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scenario(spark, sf_dir).segments.select("vol", "seg").distinct()


@query
def segment_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scenario(spark, sf_dir).chunk_store.select("seg", parsing.fanout_path(F.col("chunk_id")).alias("path"), F.col("clen").alias("bytes"))


@query
def ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = Scenario(spark, sf_dir).live.groupBy("name").agg(F.sum("len").alias("size"), F.count(F.lit(1)).alias("n_chunks"))
    return live.orderBy("name")


@query
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Scenario(spark, sf_dir).manifests
    kind = m.schema["chunks"].dataType
    again = F.from_json(F.to_json("chunks"), kind, {"mode": "FAILFAST"})
    return m.select("name", F.size("chunks").cast("long").alias("n_chunks"), (again == F.col("chunks")).alias("ok"))


# The log


@query
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.log(spark, sf_dir).select("version", "name", "action", "sz").orderBy(F.desc("version"))


@query
def log_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.log(spark, sf_dir).agg(F.max("version").alias("version"))


@query
def namespace_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.namespace_at(tables.log(spark, sf_dir), oracles.PIN)


@query
def snapshot_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.snapshots(tables.log(spark, sf_dir), list(oracles.PINS))


@query
def name_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.validity(tables.log(spark, sf_dir))


@query
def checkpoint_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.checkpoints(tables.log(spark, sf_dir))


@query
def txn_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.kinds(tables.log(spark, sf_dir))


@query
def compaction_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.compactions(tables.log(spark, sf_dir))


@query
def last_compaction_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_compaction(tables.log(spark, sf_dir))


@query
def seg_index_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scenario(spark, sf_dir).segments.where(F.col("put_ord") <= oracles.PUT_PIN).select("vol", "seg", "bytes").orderBy("vol", "seg")


# Placement


@query
def volume_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scenario(spark, sf_dir)
    return placement.used(s.volumes, s.seg_index)


@query
def volume_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scenario(spark, sf_dir).stats.drop("ord")


@query
def select_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scenario(spark, sf_dir)
    wanted = spark.createDataFrame([(p,) for p in oracles.PROJECTED], "projected long")
    return placement.select_volume(s.volumes, placement.used(s.volumes, s.seg_index), wanted)


@query
def placement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scenario(spark, sf_dir).plan


# Compaction


@query
def compact_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scenario(spark, sf_dir)
    log = tables.log(spark, sf_dir)
    settings = spark.createDataFrame(list(oracles.SETTINGS), "pressure double, min_interval long, force boolean")
    now = log.agg((F.max("ts") + oracles.LATER).alias("now"))
    last = history.last_compaction(log).crossJoin(now)
    return placement.gates(s.stats, last.select((F.col("ts") - F.col("now")).alias("ts")), settings, F.lit(0))


@query
def compact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.candidates(Scenario(spark, sf_dir).stats, oracles.DEAD_GATE)


@query
def compact_live_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.live_set(Scenario(spark, sf_dir).live)


@query
def files_touching_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.files_touching(Scenario(spark, sf_dir).manifests)


@query
def select_compact_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scenario(spark, sf_dir).destinations


@query
def compact_segment_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.segment_ids(Scenario(spark, sf_dir).live)


@query
def compact_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scenario(spark, sf_dir)
    return compaction.rewrite(s.live, s.chunk_store, s.destinations).select("dest", "seg", "chunk_id", "clen")


@query
def repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scenario(spark, sf_dir)
    moved = compaction.repointed(s.manifests, "v0", "v3", "moved")
    return moved.select("name", F.explode("chunks").alias("c")).select("name", "c.idx", "c.id", "c.vol", "c.seg")


@query
def compaction_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Had compaction collected what is live after the removals, references of removed files that came back would conflict."""
    s = Scenario(spark, sf_dir)
    return compaction.conflicts(s.refs, s.live.select("vol", "id").distinct())


@query
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment k was written at second k; a quarter of an hour before the last one is still safe."""
    s = Scenario(spark, sf_dir)
    segments = s.segments.select("vol", "seg", F.col("put_ord").alias("ts"))
    now = segments.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]
    return compaction.orphans(segments, s.live, now, oracles.WINDOW)


@query
def mirror_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scenario(spark, sf_dir)
    return compaction.missing_targets(s.volumes, _values(spark, oracles.TARGETS, "vol"))


@query
def mirror_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mirror as of an earlier put and log version still lacks: segments first, log records last."""
    s = Scenario(spark, sf_dir)
    log = tables.log(spark, sf_dir).select("version")
    path = F.concat_ws("/", F.lit("volumes"), "vol", "seg")
    record = F.concat(F.lit("log/"), F.lpad(F.col("version").cast("string"), 20, "0"))
    source = s.segments.select(F.lit("segment").alias("kind"), path.alias("path"), "put_ord")
    records = log.select(F.lit("log").alias("kind"), record.alias("path"), F.col("version").alias("put_ord"))
    target = source.where(F.col("put_ord") <= oracles.PUT_PIN).unionByName(records.where(F.col("put_ord") <= oracles.PIN))
    return compaction.mirror_diff(source.unionByName(records).drop("put_ord"), target.drop("put_ord"))


# Scalar functions


@query
def parse_chunk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, oracles.SIZES, "s").select("s", parsing.chunk_size(F.col("s")).alias("bytes"))


@query
def parse_volume_arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _values(spark, oracles.VOLUME_ARGS, "s").select("s", parsing.volume_id(s).alias("id"), parsing.volume_url(s).alias("url"))


@query
def url_owner_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    urls = tables.table(spark, sf_dir, "pages").select("url").distinct().unionByName(_values(spark, oracles.URLS, "url"))
    return urls.select("url", parsing.url_owner(u).alias("owner"), parsing.url_name(u).alias("name"))


@query
def base64_(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = tables.table(spark, sf_dir, "benchmark").select(F.col("text").alias("in"))
    return text.select("in", F.replace(F.base64(F.col("in").cast("binary")), F.lit("\r\n"), F.lit("")).alias("out"))


@query
def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = tables.table(spark, sf_dir, "benchmark").select(F.col("text").alias("in"))
    return text.select("in", F.decode(F.unhex(F.lower(F.hex(F.col("in").cast("binary")))), "UTF-8").alias("out"))


@query
def rate_limit_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = tables.table(spark, sf_dir, "conversations").select(F.col("text").alias("s")).distinct()
    return texts.unionByName(_values(spark, oracles.ANSWERS, "s")).select("s", parsing.rate_limited(F.col("s")).alias("limited"))


@query
def hmac_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed tag of every file name, the key from an Arrow-free column so that built-in hashing does all of it."""
    files = tables.documents(spark, sf_dir).select("name")
    key = F.unhex(F.lit(oracles.TAG_KEY.ljust(64, b"\0").hex()))
    return files.select("name", sealing.hmac_sha256(key, F.col("name").cast("binary")).alias("tag"))


# Sealing


@query
def zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = tables.documents(spark, sf_dir).select("name", F.col("content").alias("data"))
    back = sealing.opened(sealing.sealed(whole, KEYS), KEYS)
    hashed = F.sha2("data", 256) == F.col("plaintext_hash")
    return back.select("name", hashed.alias("ok"))


def _sealed_chunks(spark: SparkSession, sf_dir: str, keys: sealing.Keys = KEYS) -> DataFrame:
    return sealing.sealed_files(tables.documents(spark, sf_dir), keys, AVG, SEED)


@query
def seal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.documents(spark, sf_dir)
    whole = chunked.reassembled(files, sealing.opened(_sealed_chunks(spark, sf_dir), KEYS))
    both = files.join(whole.withColumnRenamed("content", "again"), "name")
    return both.select("name", (F.col("content") == F.col("again")).alias("ok"))


@query
def seal_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sealed_chunks(spark, sf_dir).groupBy("plaintext_hash", "chunk_id").agg(F.lit(1).alias("one"))
    return rows.agg(F.count_distinct("plaintext_hash").alias("distinct_plain"), F.count_distinct("chunk_id").alias("distinct_sealed"))


@query
def tamper_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sealed chunk with one bit of its middle byte flipped: none may open."""
    rows = _sealed_chunks(spark, sf_dir)
    middle = F.floor(F.octet_length("ciphertext") / 2).cast("int") + 1
    byte = F.conv(F.hex(F.substring("ciphertext", middle, F.lit(1))), 16, 10).cast("int")
    flipped = F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(1))), 2, "0"))
    rest = F.substring("ciphertext", middle + 1, F.octet_length("ciphertext"))
    broken = rows.withColumn("ciphertext", F.concat(F.substring("ciphertext", F.lit(1), middle - 1), flipped, rest))
    back = sealing.opened(broken, KEYS, strict=False)
    return back.agg(F.count(F.lit(1)).alias("tried"), F.count(F.when(F.col("data").isNull(), 1)).alias("rejected"))


@query
def store_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine, other = (_sealed_chunks(spark, sf_dir, k).select("chunk_id").distinct() for k in (KEYS, OTHER_KEYS))
    return mine.join(other, "chunk_id", "left_semi").agg(F.count(F.lit(1)).alias("shared"))


@query
def txn_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's put record, sealed as chunks and manifests are, and decoded again."""
    m = Scenario(spark, sf_dir).manifests
    record = m.select("name", F.to_json(F.struct(F.lit("delta").alias("kind"), "name", "chunks")).alias("json"))
    sealed_rows = sealing.sealed(record.select("name", F.col("json").cast("binary").alias("data")), KEYS)
    back = sealing.opened(sealed_rows, KEYS)
    kind = m.schema["chunks"].dataType.simpleString()
    parsed = F.from_json(F.decode("data", "UTF-8"), f"struct<kind:string,name:string,chunks:{kind}>", {"mode": "FAILFAST"})
    decoded = back.select("name", parsed.alias("txn")).join(m, "name")
    ok: Column = (F.col("txn.kind") == "delta") & (F.col("txn.name") == F.col("name")) & (F.col("txn.chunks") == F.col("chunks"))
    return decoded.select("name", ok.alias("ok"))

