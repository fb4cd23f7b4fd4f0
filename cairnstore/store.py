"""A transactional, content-addressed, deduplicating store of files.

Bytes are chunks in immutable Parquet segments under volumes; manifests are
Parquet as well. One sealed JSON record for each transaction makes up the log,
and creating the next record's file is the only commit. Data is written before it
is referred to and deleted after nothing refers to it, so whatever dies in
between leaves the store as it was.

A namespace is a DataFrame: the last checkpoint and the records after it, the
last action of each name winning. Only records, never manifests or chunks, are
handled on the driver.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import secrets
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from functools import partial, reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .files import Files
from .functions import chunking, sealing
from .functions.parsing import fanout_path, says_rate_limited
from .operators import compaction, placement
from .sources import schemas

RETRIES = 32
#: Rate-limited writes are tried again so often, after this many seconds doubled each time and a little more.
PUSH_RETRIES, PUSH_WAIT, PUSH_JITTER = 5, 0.5, 0.25
DEFAULT_THRESHOLD = 4 << 30
#: So many names at most are literals of a plan, which scans can skip by; each costs the driver some calls, so more are joined.
LITERALS = 100
#: A put that is split is cut by sums over its chunks' ids up to so many digits: 65,536 at most reach the driver.
CUT_DIGITS = 4
#: Where a test may stop the engine.
HOOKS = (
    "before-segment",
    "after-segment",
    "before-cas",
    "after-cas",
    "compact-after-rewrite",
    "compact-before-cas",
    "compact-after-cas",
    "compact-before-delete",
    "before-sweep",
)


class StoreError(Exception):
    """The store refuses: an unknown name or version, a conflict, a wrong key, corrupted bytes."""


class BudgetExhausted(StoreError):
    """No writable volume has room."""


@dataclass(frozen=True)
class Volume:
    id: str
    url: str | None = None
    push_interval_ms: int = 0
    threshold: int = DEFAULT_THRESHOLD

    @staticmethod
    def parse(text: str) -> Volume:
        name, sign, url = text.partition("=")
        if not (name and sign and url):
            raise ValueError(f"a volume is ID=URL, not {text!r}")
        return Volume(name, url)


@dataclass(frozen=True)
class Gates:
    dead_ratio: float = 0.50
    pressure: float = 0.80
    min_interval: int = 24 * 3600
    orphan_window: int = 3600

    @staticmethod
    def from_env() -> Gates:
        """Defaults overridden by STORE_DEAD_RATIO and the like; values that don't parse are ignored."""
        out = {}
        for name, kind in (("dead_ratio", float), ("pressure", float), ("min_interval", int), ("orphan_window", int)):
            try:
                out[name] = kind(os.environ[f"STORE_{name.upper()}"])
            except (KeyError, ValueError):
                continue
        return Gates(**out)


@dataclass(frozen=True)
class Config:
    avg_size: int = chunking.DEFAULT_AVG
    zstd_level: int = sealing.ZSTD_LEVEL
    checkpoint_interval: int = schemas.CHECKPOINT_INTERVAL
    volumes: tuple[Volume, ...] = (Volume("v0"),)
    sealed: bool = True
    version: int = sealing.FORMAT_VERSION

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Config:
        raw = json.loads(text)
        return Config(**raw | {"volumes": tuple(Volume(**v) for v in raw["volumes"])})


@dataclass
class State:
    """What the log says at a version: records since its checkpoint, and the segments with the bytes of their chunks and what these take up."""

    version: int
    base: int | None
    records: list[dict]
    seals: dict[tuple[str, str], int] = field(default_factory=dict)
    stored: dict[tuple[str, str], int] = field(default_factory=dict)

    def seal(self, records: Iterable[dict]) -> None:
        for s in records:
            self.seals[s["vol"], s["seg"]] = s["bytes"]
            self.stored[s["vol"], s["seg"]] = s.get("stored", s["bytes"])

    def index(self) -> list[dict]:
        return [{"vol": v, "seg": s, "bytes": b, "stored": self.stored[v, s]} for (v, s), b in sorted(self.seals.items())]

    @property
    def since(self) -> int:
        return len(self.records)

    def apply(self, record: dict) -> None:
        """What a record says about segments: sealed ones come first, then those of retired volumes and swept ones go."""
        self.seal(record.get("seals") or ())
        retired, swept = set(record.get("retired") or ()), {tuple(x) for x in record.get("swept") or ()}
        if retired or swept:
            self.seals = {k: b for k, b in self.seals.items() if k[0] not in retired and k not in swept}
            self.stored = {k: self.stored[k] for k in self.seals}

    def gone(self, since: int) -> tuple[set[str], set[tuple[str, str]]] | None:
        """Volumes retired and segments swept after a version; None if records of that time are folded into a checkpoint."""
        if self.base is not None and self.base > since:
            return None
        late = [r for r in self.records if r["version"] > since]
        return {v for r in late for v in r.get("retired") or ()}, {tuple(x) for r in late for x in r.get("swept") or ()}

    def used(self) -> dict[str, int]:
        """Bytes of a volume's chunks: ciphertexts, or plaintexts in a plain store."""
        return self._by_volume(self.seals)

    def held(self) -> dict[str, int]:
        """What a volume's budget bounds: bytes of chunks as they are stored, which in a plain store are compressed."""
        return self._by_volume(self.stored)

    @staticmethod
    def _by_volume(segments: dict[tuple[str, str], int]) -> dict[str, int]:
        out: dict[str, int] = {}
        for (vol, _), size in segments.items():
            out[vol] = out.get(vol, 0) + size
        return out


@dataclass(frozen=True)
class Part:
    """What a put's new segment has on one volume: its chunks from where the part before it ends (the first) up to an id (the last)."""

    vol: str
    bytes: int
    stored: int
    start: str | None = None
    end: str | None = None

    def holds(self, chunk_id: Column) -> Column:
        after = F.lit(True) if self.start is None else chunk_id >= self.start
        return after if self.end is None else after & (chunk_id < self.end)


@dataclass(frozen=True)
class PutStats:
    """volume: where new chunks went; joined by commas where they were split."""

    committed: bool
    total_chunks: int
    new_chunks: int
    new_bytes: int
    size: int
    volume: str | None
    version: int

    @property
    def deduped(self) -> int:
        return self.total_chunks - self.new_chunks


class Store:
    def __init__(self, spark: SparkSession, root: str, keys: sealing.Keys | None, hook: Callable[[str], None] | None = None, clock=time.time):
        self.spark, self.keys, self.clock = spark, keys, clock
        self.files = Files(spark, root)
        self.hook = hook or (lambda at: None)
        if not self.files.exists("_store.json"):
            raise StoreError(f"there is no store at {root}")
        self.config = Config.from_json(self.files.read("_store.json").decode())
        if self.config.sealed and keys is None:
            raise StoreError("this store is sealed and needs its keyfile")
        self.params = chunking.ChunkerParams.from_avg(self.config.avg_size)
        self._last_push: dict[str, float] = {}

    # Opening

    @staticmethod
    def init(spark: SparkSession, root: str, keys: sealing.Keys | None, config: Config | None = None, **more) -> Store:
        """A new store with its declared volumes; one that is there already is refused."""
        config = config or Config(sealed=keys is not None)
        if not config.volumes:
            raise ValueError("a store needs at least one volume")
        if len({v.id for v in config.volumes}) != len(config.volumes):
            raise ValueError("volumes need ids of their own")
        chunking.ChunkerParams.from_avg(config.avg_size)
        files = Files(spark, root)
        full = [v.id for v in config.volumes if files.listed(f"volumes/{v.id}")]
        if full and not files.exists("_store.json"):
            raise StoreError(f"volume {full[0]!r} isn't empty: only an empty one is adopted")
        if not files.create("_store.json", config.to_json().encode()):
            raise StoreError(f"the store at {root} is already initialized")
        for v in config.volumes:
            files.make(f"volumes/{v.id}")
        return Store(spark, root, keys, **more)

    @staticmethod
    def open(spark: SparkSession, root: str, keys: sealing.Keys | None, avg_size: int | None = None, **more) -> Store:
        store = Store(spark, root, keys, **more)
        if avg_size is not None and avg_size != store.config.avg_size:
            raise StoreError(f"the store's average chunk size is {store.config.avg_size}, not {avg_size}")
        return store

    # The log

    def _crypt(self, body: bytes, seal: bool) -> bytes:
        """Records are sealed by the JVM's own cipher, on the driver, so that no plan holds the key."""
        jvm = self.spark.sparkContext._jvm
        nonce = secrets.token_bytes(12) if seal else body[:12]
        cipher = jvm.javax.crypto.Cipher.getInstance("AES/GCM/NoPadding")
        key = jvm.javax.crypto.spec.SecretKeySpec(self.keys.record, "AES")
        cipher.init(1 if seal else 2, key, jvm.javax.crypto.spec.GCMParameterSpec(128, nonce))
        cipher.updateAAD(f"v{self.config.version}".encode())
        try:
            out = bytes(cipher.doFinal(body if seal else body[12:]))
        except Exception as e:
            raise StoreError("a log record doesn't open: wrong key or corrupted bytes") from e
        return nonce + out if seal else out

    def _record_name(self, version: int) -> str:
        return f"log/{version:020d}.json"

    def _write_record(self, version: int, record: dict) -> bool:
        body = json.dumps(record, sort_keys=True).encode()
        if self.config.sealed:
            body = base64.b64encode(self._crypt(body, True))
        return self.files.create(self._record_name(version), body)

    def _read_record(self, version: int) -> dict:
        body = self.files.read(self._record_name(version))
        if self.config.sealed:
            try:
                raw = base64.b64decode(body, validate=True)
            except ValueError as e:
                raise StoreError("a log record doesn't open: wrong key or corrupted bytes") from e
            body = self._crypt(raw, False)
        return json.loads(body) | {"version": version}

    def _versions(self) -> list[int]:
        return [int(n[:20]) for n, folder, _ in self.files.listed("log") if not folder and n.endswith(".json") and n[:20].isdigit()]

    def tip(self) -> int | None:
        versions = self._versions()
        return versions[-1] if versions else None

    def state(self, at: int | None = None) -> State:
        """The state at a version (the tip): records are read back to the newest checkpoint only."""
        versions = self._versions()
        if at is not None and at not in versions:
            raise StoreError(f"the log has no version {at}")
        records: list[dict] = []
        base, index = None, []
        for version in reversed([v for v in versions if at is None or v <= at]):
            record = self._read_record(version)
            if record["kind"] == "checkpoint":
                base = version
                index = record["seg_index"]
                break
            records.append(record)
        records.reverse()
        upto = [v for v in versions if at is None or v <= at]
        state = State(upto[-1] if upto else -1, base, records)
        state.seal(index)
        for record in records:
            state.apply(record)
        return state

    def namespace(self, at: int | None = None, state: State | None = None) -> DataFrame:
        """(name, size, avg_chunk_size, file_hash, chunks) of the names alive at a version."""
        state = state or self.state(at)
        written = {r["manifests"]: r["version"] for r in state.records if r.get("manifests")}
        if state.base is not None:
            written[self._read_record(state.base)["manifests"]] = state.base
        removed = [(n, r["version"]) for r in state.records for n in r.get("remove") or ()]
        every = self._manifests(written)
        if removed:
            gone = self._frame(removed, "name string, version long")
            empty = self.spark.createDataFrame([], schemas.NAMESPACE).drop("name").schema
            gone = gone.select("name", *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.fields], "version", F.lit(1).alias("ord"))
            every = every.unionByName(gone)
        names = ["size", "avg_chunk_size", "file_hash", "chunks"]
        last = F.max_by(F.struct(*names, "ord"), F.struct("version", "ord")).alias("last")
        return every.groupBy("name").agg(last).where("last.ord = 0").select("name", *[F.col(f"last.{n}").alias(n) for n in names])

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        """A few rows that the driver knows, as a local relation."""
        kinds = self.spark.createDataFrame([], schema).schema
        columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kinds.fields)]
        return self.spark.createDataFrame(pa.Table.from_arrays(columns, names=kinds.names), kinds)

    def _manifests(self, written: dict[str, int]) -> DataFrame:
        """(name, size, avg_chunk_size, file_hash, chunks, version, ord 0) of manifests with the versions that wrote them, in one scan."""
        if not written:
            return self.spark.createDataFrame([], f"{schemas.NAMESPACE}, version long, ord int")
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        versions = F.create_map(*[F.lit(x) for at, v in written.items() for x in (at.rsplit("/", 1)[1], v)])
        version = F.element_at(versions, folder).cast("long").alias("version")
        kind = "plaintext_hash string, ciphertext binary" if self.config.sealed else schemas.NAMESPACE
        rows = self.spark.read.schema(kind).parquet(*map(self.files.path, written)).select("*", version)
        if self.config.sealed:
            row = F.from_json(F.decode("data", "UTF-8"), schemas.NAMESPACE, {"mode": "FAILFAST"})
            rows = sealing.opened(rows, self.keys).select(row.alias("row"), "version").select("row.*", "version")
        return rows.withColumn("ord", F.lit(0))

    def _write_manifests(self, rows: DataFrame, at: str) -> None:
        """Manifests as Parquet; in a sealed store each row is sealed, so that names and hashes can't be read."""
        if self.config.sealed:
            body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).cast("binary")
            rows = sealing.sealed(rows.select(body.alias("data")), self.keys, self.config.zstd_level).select("plaintext_hash", "ciphertext")
        rows.write.parquet(self.files.path(at))

    def refs(self, at: int | None = None, state: State | None = None) -> DataFrame:
        """(name, idx, id, plaintext_hash, len, clen, vol, seg) of every live file."""
        rows = self.namespace(at, state).select("name", F.posexplode("chunks").alias("idx", "c"))
        return rows.select("name", F.col("idx").cast("long").alias("idx"), "c.*")

    def seg_index(self, at: int | None = None, state: State | None = None) -> DataFrame:
        state = state or self.state(at)
        rows = [(v, s, b) for (v, s), b in sorted(state.seals.items())]
        return self._frame(rows, schemas.SEG_INDEX)

    def log(self) -> DataFrame:
        """(version, ts, kind) of all records, newest first."""
        rows = [(r["version"], r["ts"], r["kind"]) for r in map(self._read_record, reversed(self._versions()))]
        return self._frame(rows, "version long, ts long, kind string")

    def chunk_store(self, volumes: Iterable[str] | None = None) -> DataFrame:
        """(vol, seg, chunk_id, plaintext_hash, len, clen, ciphertext) of the given volumes (all); seg is a partition, so joins on it prune.

        In a plain store clen is len, and ciphertext is the chunk, compressed if it is shorter than that. Segments that nothing refers to are there too, and whatever is deleted meanwhile is missing.
        """
        wanted = [v.id for v in self.config.volumes] if volumes is None else sorted(set(volumes))
        for v in wanted:
            self.files.make(f"volumes/{v}")
        kind = f"vol string, seg string, {schemas.SEGMENT}"
        reader = self.spark.read.schema(kind).option("ignoreMissingFiles", "true")
        # A folder of its own for each volume: several roots of partitions can't be read as one.
        each = [reader.parquet(self.files.path(f"volumes/{v}")) for v in wanted]
        return reduce(DataFrame.unionByName, each).select("vol", "seg", "chunk_id", "plaintext_hash", "len", "clen", "ciphertext")

    # Writing

    def _commit(self, build: Callable[[State], dict | None]) -> int | None:
        """Append what build makes of the current state; None if it makes nothing. Retried when another writer was first."""
        for _ in range(RETRIES):
            state = self.state()
            record = build(state)
            if record is None:
                return None
            version = state.version + 1
            if record["kind"] == "delta" and state.since + 1 >= self.config.checkpoint_interval:
                record = self._checkpoint(state, record, version)
            self.hook("compact-before-cas" if record["kind"] == "compact" else "before-cas")
            if self._write_record(version, record):
                self.hook("compact-after-cas" if record["kind"] == "compact" else "after-cas")
                return version
        raise StoreError(f"gave up after {RETRIES} conflicting commits")

    def _checkpoint(self, state: State, record: dict, version: int) -> dict:
        """The record folded into a full snapshot of the namespace and the segment index."""
        after = State(version, state.base, [*state.records, record | {"version": version}], dict(state.seals), dict(state.stored))
        after.apply(record)
        at = f"manifests/checkpoint-{version:020d}-{secrets.token_hex(8)}"
        self._write_manifests(self.namespace(state=after), at)
        last = self._last_compaction(state)
        return {"kind": "checkpoint", "ts": record["ts"], "manifests": at, "seg_index": after.index(), "token": record.get("token"), "compacted": last}

    def _last_compaction(self, state: State) -> int | None:
        """When the last compaction was: in a record since the checkpoint, or as the checkpoint says."""
        times = [r["ts"] for r in state.records if r["kind"] == "compact"]
        return times[-1] if times else self._read_record(state.base).get("compacted") if state.base is not None else None

    def spare(self) -> str | None:
        """The last declared of three volumes or more is kept free for compaction."""
        return self.config.volumes[-1].id if len(self.config.volumes) >= 3 else None

    def _choose(self, fresh: DataFrame, size: int, stored: int, state: State) -> list[Part]:
        """Where new chunks go: to the roomiest volume, or, where none has room for all, in order of their ids to one volume after the other.

        The roomiest is the one with the most room beside its chunks' bytes, as they are listed; what is stored decides whether
        chunks fit. The roomiest volume is filled first, each to less than a chunk. A chunk that the volumes left have no room for is refused.
        """
        used, held = state.used(), state.held()
        order = sorted((used.get(v.id, 0) - v.threshold, k) for k, v in enumerate(self.config.volumes) if v.id != self.spare())
        writable = [self.config.volumes[k] for _, k in order]
        room = [(v.threshold - held.get(v.id, 0), v.id) for v in writable if v.threshold > held.get(v.id, 0)]
        for left, vol in room:
            if left >= stored:
                return [Part(vol, size, stored)]
        refused = BudgetExhausted(f"the writable volumes have no room for {stored} bytes; compact, or add volumes")
        if sum(left for left, _ in room) < stored:
            raise refused
        prefix = F.substring("chunk_id", 1, CUT_DIGITS)
        cuts: list[str] = []
        taken = [(0, 0)]
        for group, kept, total in sorted(tuple(r) for r in fresh.groupBy(prefix).agg(F.sum("stored"), F.sum("clen")).collect()):
            if taken[-1][0] + kept <= room[len(cuts)][0]:
                taken[-1] = taken[-1][0] + kept, taken[-1][1] + total
                continue
            # A part ends among these chunks.
            for chunk, one, clen in sorted(tuple(r) for r in fresh.where(prefix == group).select("chunk_id", "stored", "clen").collect()):
                while taken[-1][0] + one > room[len(cuts)][0]:
                    cuts.append(chunk)
                    taken.append((0, 0))
                    if len(cuts) == len(room):
                        raise refused
                taken[-1] = taken[-1][0] + one, taken[-1][1] + clen
        parts = [Part(r[1], n, kept, start, end) for r, (kept, n), start, end in zip(room, taken, [None, *cuts], [*cuts, None], strict=False)]
        return [p for p in parts if p.bytes]

    def _throttle(self, vol: str) -> None:
        interval = next(v.push_interval_ms for v in self.config.volumes if v.id == vol) / 1000
        wait = self._last_push.get(vol, -interval) + interval - time.monotonic()
        if interval and wait > 0:
            time.sleep(wait)
        self._last_push[vol] = time.monotonic()

    def _pushed(self, vol: str, action: Callable[[], None], sleep: Callable[[float], None] = time.sleep) -> None:
        """Do one write to a volume, throttled, and again after a while if its host says that it was too soon."""
        for attempt in range(PUSH_RETRIES + 1):
            self._throttle(vol)
            try:
                return action()
            except Exception as e:
                if attempt == PUSH_RETRIES or not says_rate_limited(str(e)):
                    raise
                sleep(PUSH_WAIT * 2**attempt + PUSH_JITTER * secrets.randbelow(1000) / 1000)

    def _sealed(self, files: DataFrame) -> DataFrame:
        if self.config.sealed:
            chunks = sealing.sealed_files(files, self.keys, self.config.avg_size, self.keys.gear_seed, self.config.zstd_level)
        else:
            chunks = chunking.cdc_chunks(files, self.config.avg_size, 0, level=self.config.zstd_level)
            chunks = chunks.withColumns({"plaintext_hash": F.col("chunk_id"), "clen": F.col("len")}).withColumnRenamed("data", "ciphertext")
        return chunks.withColumn("stored", F.octet_length("ciphertext").cast("long"))

    def has_token(self, token: str) -> bool:
        return self.files.exists(f"tokens/{token}") or any(self._read_record(v).get("token") == token for v in reversed(self._versions()[-2 * self.config.checkpoint_interval :]))

    def put(self, name: str, body: bytes) -> PutStats:
        return self.put_batch(self._frame([(name, body)], schemas.FILES))

    def put_batch(self, files: DataFrame, token: str | None = None) -> PutStats:
        """Put files(name, content), each name once, as one transaction and one segment.

        Chunks that the current namespace has are referred to, not stored; a batch whose
        manifests are all as they were commits nothing. With a token, a batch that was
        committed before commits nothing. A segment that no volume has room for is split
        over several; nothing is written if they have no room together.
        """
        if token is not None and self.has_token(token):
            return PutStats(False, 0, 0, 0, 0, None, self.tip())
        work = secrets.token_hex(16)
        staged_at = self.files.path(f"staging/{work}")
        files = files.select("name", F.coalesce("content", F.lit(b"")).alias("content"))
        try:
            self._sealed(files).select("name", "idx", "len", "chunk_id", "plaintext_hash", "clen", "stored", "ciphertext").write.parquet(f"{staged_at}/chunks")
            heads = files.select("name", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("file_hash"))
            heads.write.parquet(f"{staged_at}/heads")
            staged, heads = (self.spark.read.parquet(f"{staged_at}/{x}") for x in ("chunks", "heads"))
            names, n, size = heads.agg(F.count_distinct("name"), F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
            if names != n:
                raise StoreError("a batch may put each name once, and names can't be null")
            for _ in range(RETRIES):
                done = self._put_once(staged, heads, secrets.token_hex(16), token, size)
                if done is not None:
                    return done
            raise StoreError("gave up: what this put refers to kept being retired or swept")
        finally:
            self.files.delete(f"staging/{work}")

    def _put_once(self, staged: DataFrame, heads: DataFrame, seg: str, token: str | None, size: int) -> PutStats | None:
        """One attempt against one state; None if a segment it refers to was retired or swept before the commit."""
        state = self.state()
        now = self.namespace(state=state).persist()
        try:
            return self._attempt(state, now, staged, heads, seg, token, size)
        finally:
            now.unpersist()

    def _attempt(self, state: State, now: DataFrame, staged: DataFrame, heads: DataFrame, seg: str, token: str | None, size: int) -> PutStats | None:
        refs = now.select(F.explode("chunks").alias("c")).select("c.*")
        known = refs.groupBy("id").agg(F.min(F.struct("vol", "seg")).alias("at"))
        ids = staged.select("chunk_id", "len", "clen", "stored").dropDuplicates(["chunk_id"])
        fresh = ids.join(known, ids["chunk_id"] == known["id"], "left_anti")
        new, new_bytes, stored = fresh.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(x), F.lit(0)) for x in ("clen", "stored")]).first()
        total = staged.count()
        parts = self._choose(fresh, new_bytes, stored, state) if new else []
        placed = staged.drop("ciphertext").join(known, staged["chunk_id"] == known["id"], "left")
        vol = F.coalesce(F.lit(None).cast("string"), *[F.when(p.holds(F.col("chunk_id")), p.vol) for p in parts])
        where = {x: F.coalesce(F.col(f"at.{x}"), c) for x, c in (("vol", vol), ("seg", F.lit(seg if parts else None)))}
        ref = F.struct(
            "idx", F.col("chunk_id").alias("id"), "plaintext_hash", "len", "clen", where["vol"].alias("vol"), where["seg"].alias("seg")
        )
        lists = placed.groupBy("name").agg(F.array_sort(F.collect_list(ref)).alias("chunks"))
        lists = lists.select("name", F.transform("chunks", lambda c: c.dropFields("idx")).alias("chunks"))
        full = heads.join(lists, "name", "left").select(
            "name",
            "size",
            F.lit(self.config.avg_size).cast("long").alias("avg_chunk_size"),
            "file_hash",
            F.coalesce("chunks", F.array().cast(f"array<{schemas.CHUNK_REF}>")).alias("chunks"),
        )
        old = now.select(F.col("name").alias("_name"), F.struct(*full.columns).alias("_old"))
        changed = full.join(old, F.col("name") == F.col("_name"), "left").where(~F.struct(*full.columns).eqNullSafe(F.col("_old")))
        changed = changed.select(*full.columns)
        at = f"manifests/{seg}-{secrets.token_hex(4)}"
        self.hook("before-segment")
        for p in parts:
            body = staged.where(p.holds(F.col("chunk_id"))).join(fresh.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
            self._pushed(p.vol, partial(self._write_segment, body, p.vol, seg))
        self._write_manifests(changed, at)
        self.hook("after-segment")
        if self._manifests({at: 0}).isEmpty():
            self.files.delete(at)
            return PutStats(False, total, new, new_bytes, size, None, state.version)
        seals = [{"vol": p.vol, "seg": seg, "bytes": p.bytes, "stored": p.stored} for p in parts]
        used = self._manifests({at: 0}).select(F.explode("chunks").alias("c")).select("c.vol", "c.seg")
        retired = False

        def build(current: State) -> dict | None:
            nonlocal retired
            gone = current.gone(state.version)
            retired = gone is None or bool(any(gone)) and not used.where(F.col("vol").isin(list(gone[0])) | self._among(gone[1])).isEmpty()
            if retired:
                return None
            return {"kind": "delta", "ts": int(self.clock()), "manifests": at, "seals": seals, "token": token}

        version = self._commit(build)
        if retired:
            return None
        if token is not None:
            self.files.create(f"tokens/{token}", b"")
        return PutStats(True, total, new, new_bytes, size, ",".join(p.vol for p in parts) or None, version)

    @staticmethod
    def _among(segments: set[tuple[str, str]]) -> Column:
        """Whether (vol, seg) is one of the given segments."""
        return F.concat_ws("/", "vol", "seg").isin([f"{v}/{s}" for v, s in sorted(segments)])

    def _write_segment(self, rows: DataFrame, vol: str, seg: str) -> None:
        """One immutable segment, ordered by chunk id, with a bloom filter on it; written again whole if an attempt was cut short."""
        # A plaintext's hash would tell who has it; in a sealed store only manifests hold it.
        plain = F.lit(None).cast("string") if self.config.sealed else F.col("plaintext_hash")
        out = rows.select(F.lit(vol).alias("vol"), F.lit(seg).alias("seg"), "chunk_id", plain.alias("plaintext_hash"), "len", "clen", "ciphertext")
        writer = out.repartitionByRange(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "chunk_id").sortWithinPartitions("chunk_id")
        writer.write.mode("overwrite").option("parquet.bloom.filter.enabled#chunk_id", "true").parquet(self.files.path(f"volumes/{vol}/seg={seg}"))

    def _named(self, rows: DataFrame, names: Iterable[str]) -> DataFrame:
        """Rows of the given names."""
        names = list(names)
        if len(names) <= LITERALS:
            return rows.where(F.col("name").isin(names))
        return rows.join(self._frame([(n,) for n in names], "name string"), "name", "left_semi")

    def remove(self, *names: str) -> int | None:
        """Remove names; an unknown one is an error and commits nothing, one that a racer removed is no change."""
        alive = {r["name"] for r in self._named(self.namespace(), names).select("name").collect()}
        missing = [n for n in names if n not in alive]
        if missing:
            raise StoreError(f"no file {missing[0]!r}")

        def build(current: State) -> dict | None:
            left = {r["name"] for r in self._named(self.namespace(state=current), names).select("name").collect()}
            return {"kind": "delta", "ts": int(self.clock()), "remove": sorted(left)} if left else None

        return self._commit(build)

    # Reading

    def ls(self, at: int | None = None) -> DataFrame:
        return self.namespace(at).select("name", "size", F.size("chunks").cast("long").alias("n_chunks")).orderBy("name")

    def read(self, names: list[str] | None = None, at: int | None = None) -> DataFrame:
        """(name, idx, data) of the chunks of the given files (all), opened and verified.

        A chunk that isn't where its manifest says fails the query.
        """
        refs = self.refs(at)
        if names is not None:
            refs = self._named(refs, names)
        stored = self.chunk_store().select("vol", "seg", F.col("chunk_id").alias("id"), "ciphertext")
        got = refs.join(stored, ["vol", "seg", "id"], "left")
        missing = F.raise_error(F.concat(F.lit("a chunk is missing: "), F.col("id")))
        wrong = F.raise_error(F.concat(F.lit("a chunk doesn't have its id: "), F.col("id"))).cast("binary")
        body = F.when(F.col("ciphertext").isNull(), missing.cast("binary"))
        if self.config.sealed:
            body = body.when(F.sha2("ciphertext", 256) != F.col("id"), wrong).otherwise(F.col("ciphertext"))
            got = sealing.opened(got.select("name", "idx", "len", "plaintext_hash", body.alias("ciphertext")), self.keys)
        else:
            got = chunking.unpacked(got.select("name", "idx", "len", "id", body.otherwise(F.col("ciphertext")).alias("packed")))
            got = got.withColumn("data", F.when(F.sha2("data", 256) != F.col("id"), wrong).otherwise(F.col("data")))
        short = F.raise_error(F.lit("a chunk has another length than its manifest says")).cast("binary")
        return got.select("name", "idx", F.when(F.octet_length("data") == F.col("len"), F.col("data")).otherwise(short).alias("data"))

    def get(self, name: str, at: int | None = None, writer: BinaryIO | None = None) -> bytes | int:
        """A file's bytes, or their number if they go to a writer; a chunk at a time reaches the driver."""
        head = self.namespace(at).where(F.col("name") == name).select("size", "file_hash").first()
        if head is None:
            raise StoreError(f"no file {name!r}")
        digest, size, parts = hashlib.sha256(), 0, []
        try:
            for row in self.read([name], at).orderBy("idx").toLocalIterator():
                data = bytes(row["data"])
                digest.update(data)
                size += len(data)
                if writer is None:
                    parts.append(data)
                else:
                    writer.write(data)
        except StoreError:
            raise
        except Exception as e:
            raise StoreError(f"{name!r} can't be read: {str(e)[:300]}") from e
        if size != head["size"] or digest.hexdigest() != head["file_hash"]:
            raise StoreError(f"{name!r} doesn't have the bytes its manifest says")
        return b"".join(parts) if writer is None else size

    # Accounting and maintenance

    def volumes(self) -> DataFrame:
        rows = [(k, v.id, v.threshold, v.id == self.spare()) for k, v in enumerate(self.config.volumes)]
        return self._frame(rows, "ord long, id string, threshold long, spare boolean")

    def stats(self, at: int | None = None) -> DataFrame:
        """Per volume its total, live and dead bytes and ratios, from metadata alone."""
        state = self.state(at)
        rows = placement.volume_stats(self.volumes(), self.seg_index(state=state), self.refs(state=state))
        held = F.create_map(*[F.lit(x) for v in self.config.volumes for x in (v.id, state.held().get(v.id, 0))])
        rows = rows.withColumn("utilization", placement.ratio(F.element_at(held, F.col("id")).cast("long"), F.col("threshold")))
        return rows.orderBy("ord").drop("ord")

    def compact(self, gates: Gates | None = None, force: bool = False) -> dict:
        """Move what is live off volumes that are mostly dead and empty them; sweep segments that nothing refers to.

        Runs under pressure and after the interval, or if forced; the dead ratio always
        decides about a volume. State is read anew for each volume.
        """
        gates = gates or Gates.from_env()
        last = self._last_compaction(self.state())
        stats = {r["id"]: r for r in self.stats().collect()}
        pressed = any(r["utilization"] >= gates.pressure for r in stats.values() if not r["spare"])
        rested = last is None or self.clock() - last >= gates.min_interval
        report: list[dict] = []
        if force or (pressed and rested):
            for vol, r in stats.items():
                if not r["spare"] and r["total"] > 0 and r["dead_ratio"] > gates.dead_ratio:
                    done = self._compact_one(vol)
                    if done:
                        report.append(done)
        return {"compacted": report, "orphans_swept": self._sweep(gates.orphan_window)}

    def _destination(self, vol: str, size: int, held: dict[str, int]) -> str | None:
        room = {v.id: v.threshold - held.get(v.id, 0) for v in self.config.volumes}
        spare = self.spare()
        if spare and spare != vol and room[spare] >= size:
            return spare
        rest = [(room[v.id], -k, v.id) for k, v in enumerate(self.config.volumes) if v.id not in (vol, spare) and room[v.id] >= size]
        return max(rest)[2] if rest else None

    def _compact_one(self, vol: str) -> dict | None:
        state = self.state()
        refs = self.refs(state=state).where(F.col("vol") == vol)
        live = refs.select("vol", "seg", "id", "clen").dropDuplicates(["id"])
        count, size = live.agg(F.count(F.lit(1)), F.coalesce(F.sum("clen"), F.lit(0))).first()
        wanted = live.select("seg", F.col("id").alias("chunk_id"))
        rows = self.chunk_store([vol]).join(wanted, ["seg", "chunk_id"], "left_semi").drop("vol", "seg")
        stored = size
        if count and not self.config.sealed:
            stored = rows.select("chunk_id", F.octet_length("ciphertext").alias("n")).dropDuplicates(["chunk_id"]).agg(F.sum("n")).first()[0] or 0
        dest = self._destination(vol, stored, state.held())
        if dest is None:
            return None
        seals, seg = [], None
        if count:
            seg = compaction.segment_ids(refs).first()["seg"]
            if not self.files.exists(f"volumes/{dest}/seg={seg}/_SUCCESS"):
                rows = rows.dropDuplicates(["chunk_id"])
                if rows.count() != count:
                    raise StoreError(f"{vol} lacks chunks that are referred to")
                self._pushed(dest, lambda: self._write_segment(rows, dest, seg))
            seals = [{"vol": dest, "seg": seg, "bytes": size, "stored": stored}]
        self.hook("compact-after-rewrite")
        moved = self.chunk_store([dest]).where(F.col("seg") == seg).select(F.lit(vol).alias("vol"), F.col("chunk_id").alias("id")) if seg else None
        aborted, emptied = False, []

        def build(current: State) -> dict | None:
            nonlocal aborted, emptied
            gone = current.gone(state.version)
            # What is written to the volume after the record retires it is another put's.
            emptied = [n for n, folder, _ in self.files.listed(f"volumes/{vol}") if folder]
            if gone is None or dest in gone[0] or (dest, seg) in gone[1]:
                aborted = True
                return None
            touching = self.refs(state=current).where(F.col("vol") == vol).select("vol", "id").distinct()
            left = touching.join(moved, ["vol", "id"], "left_anti") if moved is not None else touching
            if not left.isEmpty():
                aborted = True
                return None
            record = {"kind": "compact", "ts": int(self.clock()), "retired": [vol], "seals": seals}
            if seg:
                at = f"manifests/compact-{seg}-{secrets.token_hex(4)}"
                self._write_manifests(compaction.repointed(self.namespace(state=current), vol, dest, seg), at)
                record["manifests"] = at
            return record

        self._commit(build)
        if aborted:
            return None
        before = state.used().get(vol, 0)
        self.hook("compact-before-delete")
        for name in emptied:
            self.files.delete(f"volumes/{vol}/{name}")
        return {"volume": vol, "dest_volume": dest, "bytes_before": before, "bytes_after": 0, "chunks_moved": count}

    def _sweep(self, window: int) -> int:
        """Delete segments that nothing refers to and that are older than the window (a put may still be writing younger ones); their number.

        A record names them first: a put that refers to one of them and commits later sees
        it and starts again, one that commits before is seen when the record is made.
        """
        rows = []
        for v in self.config.volumes:
            rows += [(v.id, n[4:], ts) for n, folder, ts in self.files.listed(f"volumes/{v.id}") if folder and n.startswith("seg=")]
        if not rows:
            return 0
        segments = self._frame(rows, "vol string, seg string, ts long")
        swept: list[list[str]] = []

        def build(current: State) -> dict | None:
            nonlocal swept
            lost = compaction.orphans(segments, self.refs(state=current), int(self.clock()), window)
            swept = sorted([r["vol"], r["seg"]] for r in lost.collect())
            return {"kind": "delta", "ts": int(self.clock()), "swept": swept} if swept else None

        self._commit(build)
        self.hook("before-sweep")
        for vol, seg in swept:
            self.files.delete(f"volumes/{vol}/seg={seg}")
        return len({seg for _, seg in swept})

    def mirror(self, index: str, volumes: dict[str, str]) -> int:
        """Copy what the targets lack: every volume's segments first, manifests next, log records last and in order.

        Every volume needs a target. Nothing is deleted at a target. Returns the number of files copied.
        """
        missing = [v.id for v in self.config.volumes if v.id not in volumes]
        if missing:
            raise StoreError(f"no target for volume {missing[0]!r}")
        copied = 0
        targets = {root: Files(self.spark, root) for root in {index, *volumes.values()}}
        for v in self.config.volumes:
            copied += self._copy(targets[volumes[v.id]], f"volumes/{v.id}")
        copied += self._copy(targets[index], "manifests")
        if not targets[index].exists("_store.json"):
            targets[index].create("_store.json", self.files.read("_store.json"))
        for name in sorted(self.files.every("log")):
            if not targets[index].exists(name):
                copied += targets[index].create(name, self.files.read(name))
        return copied

    def _copy(self, target: Files, folder: str) -> int:
        target.make(folder)
        have = set(target.every(folder))
        todo = [n for n in self.files.every(folder) if n not in have]
        for name in sorted(todo, key=lambda n: n.endswith("_SUCCESS")):
            self.files.copy_to(target, name)
        return len(todo)

    def segment_listing(self) -> DataFrame:
        """(vol, seg, path, bytes) of every stored chunk, without reading any ciphertext."""
        rows = self.chunk_store().join(self.seg_index().select("vol", "seg"), ["vol", "seg"], "left_semi")
        return rows.select("vol", "seg", fanout_path(F.col("chunk_id")).alias("path"), F.col("clen").alias("bytes"))
