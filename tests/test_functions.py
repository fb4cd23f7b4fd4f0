"""Chunking, parsing and sealing against plain loops and known answers."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnstore.functions import chunking, parsing, sealing
from cairnstore.operators import chunked

SEED = 7


def plain_cuts(data, p, seed):
    """The cut rule byte by byte."""
    gear, ends, start = chunking.gear_table(seed), [], 0
    hard, easy = p.masks
    while start < len(data):
        n = len(data) - start
        if n <= p.min_size:
            end = n
        else:
            limit = min(n, p.max_size)
            normal, h, end = min(p.avg_size, limit), 0, limit
            for i in range(p.min_size, limit):
                h = ((h << 1) + gear[data[start + i]]) % (1 << 64)
                if not h & (hard if i < normal else easy):
                    end = i + 1
                    break
        start += end
        ends.append(start)
    return ends


def noise(n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


@pytest.mark.parametrize("avg", [1024, 1500, 4096, 65_536])
def test_cuts_follow_the_rule(avg):
    p = chunking.ChunkerParams.from_avg(avg)
    sizes = [0, 1, 2, 5, p.min_size - 1, p.min_size, p.min_size + 1, avg, p.max_size - 1, p.max_size, p.max_size + 1, 200_000]
    for n in sizes:
        for data in (noise(n), b"\0" * n, b"ab" * (n // 2), noise(97) * (n // 97)):
            assert chunking.cut_points(data, p, SEED) == plain_cuts(data, p, SEED)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.integers(0, 2**64 - 1))
def test_cuts_of_any_bytes(data, seed):
    p = chunking.ChunkerParams.from_avg(1024)
    ends = chunking.cut_points(data, p, seed)
    assert ends == plain_cuts(data, p, seed) and b"".join(chunking.chunks(data, p, seed)) == data
    lengths = np.diff([0, *ends])
    assert all(p.min_size < n <= p.max_size for n in lengths[:-1])


def test_large_boundary_file():
    p = chunking.ChunkerParams.from_avg(65_536)
    data = noise(5 * (1 << 20) + 777)
    assert chunking.cut_points(data, p, SEED) == plain_cuts(data, p, SEED)


def test_seeds_move_cuts_and_inserts_keep_most_chunks():
    p = chunking.ChunkerParams.from_avg(4096)
    data = noise(512 << 10)
    assert chunking.cut_points(data, p, 1) != chunking.cut_points(data, p, 2)
    edited = data[: 256 << 10] + b"\xaa" * 100 + data[256 << 10 :]
    old = set(chunking.chunks(data, p, 1))
    kept = sum(len(c) for c in chunking.chunks(edited, p, 1) if c in old)
    assert kept >= 0.8 * len(edited)


def test_sizes_out_of_bounds():
    for avg in (1023, (16 << 20) + 1):
        with pytest.raises(ValueError):
            chunking.ChunkerParams.from_avg(avg)


def test_gear_table_is_splitmix():
    assert chunking.gear_table(0)[:2] == (0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4)


def test_fixed_slices_and_reassembly(spark):
    rows = [("a", bytearray(noise(2500))), ("b", bytearray(b"")), ("c", bytearray(noise(1024)))]
    files = spark.createDataFrame(rows, "name string, content binary")
    got = {(r["name"], r["idx"]): (r["len"], r["chunk_id"]) for r in chunked.fixed_slices(files, 1024).collect()}
    want = {(n, k): (len(c[k * 1024 : k * 1024 + 1024]), hashlib.sha256(c[k * 1024 : k * 1024 + 1024]).hexdigest()) for n, c in rows for k in range(-(-len(c) // 1024))}
    assert got == want
    whole = chunked.reassembled(files, chunking.cdc_chunks(files, 1024, SEED)).collect()
    assert {r["name"]: bytes(r["content"]) for r in whole} == {n: bytes(c) for n, c in rows}


def test_parsers(spark):
    cases = {"512k": 524_288, "1m": 1 << 20, " 2K ": 2048, "1023": None, "1024": 1024, "16m": 16 << 20, "17m": None, "": None, "x": None, "-5": None, "64 k": 65_536}
    df = spark.createDataFrame(list(cases.items()), "s string, want long")
    assert df.where(~parsing.chunk_size(F.col("s")).eqNullSafe(F.col("want"))).count() == 0
    urls = {"https://h.x/o/n.git": ("o", "n"), "https://h.x/g/o/n/": ("o", "n"), "https://h.x/n": (None, None), "o/n": (None, None)}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", parsing.url_owner(F.col("u")), parsing.url_name(F.col("u")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == urls


def test_hmac_by_built_in_hashing(spark):
    key = b"k" * 20
    df = spark.createDataFrame([("x",), ("",), ("ü" * 300,)], "m string")
    got = df.select("m", sealing.hmac_sha256(F.unhex(F.lit(key.ljust(64, b"\0").hex())), F.col("m").cast("binary")).alias("t"))
    assert all(r["t"] == hmac.new(key, r["m"].encode(), hashlib.sha256).hexdigest() for r in got.collect())


def test_sealing(spark):
    rows = [(k, bytearray(noise(n, k))) for k, n in enumerate((0, 1, 500, 70_000))] + [(9, bytearray(noise(500, 2)))]
    df = spark.createDataFrame(rows, "k int, data binary")
    mine, other = sealing.Keys(b"a" * 32), sealing.Keys(b"b" * 32)
    sealed = sealing.sealed(df, mine)
    assert {r["k"]: bytes(r["data"]) for r in sealing.opened(sealed, mine).collect()} == {k: bytes(d) for k, d in rows}
    ids = {r["k"]: r["chunk_id"] for r in sealed.collect()}
    assert ids[2] == ids[9] and len(set(ids.values())) == 4
    assert not set(ids.values()) & {r["chunk_id"] for r in sealing.sealed(df, other).collect()}
    assert all(r["data"] is None for r in sealing.opened(sealed, other, strict=False).collect())
    assert mine.chunk.hex() not in sealed._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="doesn't open"):
        sealing.opened(sealed, other).collect()


def test_keyfiles(tmp_path):
    path = str(tmp_path / "key")
    with pytest.raises(FileNotFoundError):
        sealing.load_keyfile(path)
    keys = sealing.load_keyfile(path, create=True)
    assert sealing.load_keyfile(path).master == keys.master and (tmp_path / "key").stat().st_mode & 0o777 == 0o600
    for bad in ("", "ab", "g" * 64, "a" * 65):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(ValueError):
            sealing.load_keyfile(str(tmp_path / "bad"))


def test_table_function(spark):
    from cairnstore.functions import udtf

    udtf.register(spark)
    files = spark.createDataFrame([("a", bytearray(noise(9000))), ("b", bytearray())], "name string, content binary")
    files.createOrReplaceTempView("cdc_files")
    got = spark.sql("SELECT f.name, c.* FROM cdc_files f, LATERAL cdc(f.content, 1024, 7) c")
    want = chunking.cdc_chunks(files, 1024, 7, data=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
