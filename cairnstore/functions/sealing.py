"""Keys, compression and sealing.

Keys are derived from a 32-byte master by HMAC-SHA256. A chunk's key and nonce
depend on its plaintext's hash, so equal plaintext seals to equal ciphertext within
a store and to unrelated bytes in another. Keys never stand in a query plan: an
Arrow function computes them from its closure and passes them on as columns, and
Spark's own AES-GCM seals.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .chunking import CHUNK_LIMIT, ChunkerParams, cut_points

FORMAT_VERSION = 1
ZSTD_LEVEL = 3


def derive(key: bytes, purpose: str) -> bytes:
    return hmac.new(key, purpose.encode(), hashlib.sha256).digest()


def prf(key: bytes, *parts: bytes) -> bytes:
    return hmac.new(key, b"".join(parts), hashlib.sha256).digest()


@dataclass(frozen=True)
class Keys:
    master: bytes

    def __post_init__(self) -> None:
        if len(self.master) != 32:
            raise ValueError("the master key must have 32 bytes")

    @property
    def chunk(self) -> bytes:
        return derive(self.master, "chunk sealing")

    @property
    def record(self) -> bytes:
        return derive(self.master, "record sealing")

    @property
    def names(self) -> bytes:
        return derive(self.master, "name tags")

    @property
    def gear_seed(self) -> int:
        return int.from_bytes(derive(self.master, "gear table")[:8], "little")


def load_keyfile(path: str, create: bool = False) -> Keys:
    """The master key of a file with 64 hexadecimal digits; a missing file is made only if asked for, for its owner only."""
    file = Path(path)
    if not file.exists():
        if not create:
            raise FileNotFoundError(f"no keyfile at {path}: an existing store needs the one it was made with")
        with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(os.urandom(32).hex() + "\n")
    text = file.read_text().strip()
    if len(text) != 64 or not set(text.lower()) <= set("0123456789abcdef"):
        raise ValueError(f"{path} doesn't hold 64 hexadecimal digits")
    return Keys(bytes.fromhex(text))


def associated() -> Column:
    """What every sealed value is bound to: the format's version."""
    return F.lit(f"v{FORMAT_VERSION}".encode())


_PREPARED = "plaintext_hash string, _packed binary, _key binary, _iv binary"
#: Bytes of chunks that a task holds before it passes them on.
_HELD = 1 << 24


def _prepared(bodies: list[bytes], key: bytes, packer) -> list[pa.Array]:
    """The columns _PREPARED of some plaintexts."""
    hashes = [hashlib.sha256(b).digest() for b in bodies]
    return [
        pa.array([h.hex() for h in hashes], pa.string()),
        pa.array([packer.compress(b) for b in bodies], pa.binary()),
        pa.array([prf(key, b"key", h) for h in hashes], pa.binary()),
        pa.array([prf(key, b"nonce", h)[:12] for h in hashes], pa.binary()),
    ]


def _encrypted(prepared: DataFrame) -> DataFrame:
    cipher = F.aes_encrypt("_packed", "_key", F.lit("GCM"), F.lit("DEFAULT"), F.col("_iv"), associated())
    out = prepared.withColumn("ciphertext", cipher).drop("_packed", "_key", "_iv")
    return out.withColumn("chunk_id", F.sha2("ciphertext", 256)).withColumn("clen", F.octet_length("ciphertext").cast("long"))


def sealed(chunks: DataFrame, keys: Keys, level: int = ZSTD_LEVEL) -> DataFrame:
    """chunks (with data) with plaintext_hash, ciphertext, chunk_id (of the ciphertext) and clen; data is dropped."""
    key = keys.chunk
    names = [c for c in chunks.columns if c not in ("data", "chunk_id", "plaintext_hash", "ciphertext", "clen")]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            added = _prepared([x or b"" for x in batch.column(len(names)).to_pylist()], key, packer)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], names=[*names, "plaintext_hash", "_packed", "_key", "_iv"])

    kept = "".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}, " for c in names)
    return _encrypted(chunks.select(*names, "data").mapInArrow(prepare, f"{kept}{_PREPARED}"))


def sealed_files(files: DataFrame, keys: Keys, avg: int, seed: int, level: int = ZSTD_LEVEL) -> DataFrame:
    """sealed() of the chunks (name, idx, offset, len) of files(name, content): cut, hashed, compressed and keyed in one pass.

    A null content is empty and has no chunks. A file's rows are emitted in bounded batches.
    """
    key, params = keys.chunk, ChunkerParams.from_avg(avg)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        rows: list[tuple[str, int, int, int]] = []
        bodies: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            name, idx, offset, length = zip(*rows, strict=True)
            columns = [pa.array(name, pa.string()), *(pa.array(c, pa.int64()) for c in (idx, offset, length)), *_prepared(bodies, key, packer)]
            return pa.RecordBatch.from_arrays(columns, names=["name", "idx", "offset", "len", "plaintext_hash", "_packed", "_key", "_iv"])

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                body, start = content.as_py() or b"", 0
                for k, end in enumerate(cut_points(body, params, seed)):
                    rows.append((name.as_py(), k, start, end - start))
                    bodies.append(body[start:end])
                    held += end - start
                    start = end
                    if held > _HELD:
                        yield out()
                        rows, bodies, held = [], [], 0
        if rows:
            yield out()

    return _encrypted(files.select("name", "content").mapInArrow(prepare, f"name string, idx long, offset long, len long, {_PREPARED}"))


def opened(rows: DataFrame, keys: Keys, strict: bool = True) -> DataFrame:
    """rows (with ciphertext and plaintext_hash) with their data.

    A ciphertext that doesn't open, or opens to other bytes than its hash says, fails
    the query; with strict off its data is null.
    """
    key = keys.chunk
    names = [c for c in rows.columns if c not in ("data", "_packed")]

    @arrow_udf("binary")
    def key_of(hashes: pa.Array) -> pa.Array:
        return pa.array([prf(key, b"key", bytes.fromhex(h)) for h in hashes.to_pylist()], pa.binary())

    plain = F.try_aes_decrypt("ciphertext", key_of("plaintext_hash"), F.lit("GCM"), F.lit("DEFAULT"), associated())
    kept_names = [c for c in names if c != "ciphertext"]
    packed = rows.select(*kept_names, plain.alias("_packed"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        at = kept_names.index("plaintext_hash")
        for batch in batches:
            out: list[bytes | None] = []
            for h, body in zip(batch.column(at).to_pylist(), batch.column(len(kept_names)), strict=True):
                data = None
                if body.is_valid:
                    try:
                        data = unpacker.decompress(body.as_buffer(), max_output_size=CHUNK_LIMIT)
                    except zstandard.ZstdError:
                        data = None
                    if data is not None and hashlib.sha256(data).hexdigest() != h:
                        data = None
                if data is None and strict:
                    raise ValueError("a chunk doesn't open: wrong key or corrupted bytes")
                out.append(data)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept_names)], pa.array(out, pa.binary())], names=[*kept_names, "data"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept_names)
    return packed.mapInArrow(unpack, f"{kept}, data binary")


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal by built-in hashing, for keys of 64 bytes at most (already padded with zeros)."""

    def padded(byte: int) -> Column:
        pad = F.unhex(F.lit(f"{byte:02x}" * 64))
        pairs = F.transform(
            F.sequence(F.lit(1), F.lit(64)),
            lambda i: F.lpad(
                F.hex(
                    F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.conv(F.hex(F.substring(pad, i, F.lit(1))), 16, 10).cast("int"))
                ),
                2,
                "0",
            ),
        )
        return F.unhex(F.array_join(pairs, ""))

    inner = F.sha2(F.concat(padded(0x36), message), 256)
    return F.sha2(F.concat(padded(0x5C), F.unhex(inner)), 256)
