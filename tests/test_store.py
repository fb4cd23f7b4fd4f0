"""The store end to end: round trips, dedup, faults, races, snapshots, compaction, mirrors, streams."""

from __future__ import annotations

import hashlib
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnstore.functions.sealing import Keys
from cairnstore.sources import datasource
from cairnstore.store import BudgetExhausted, Config, Gates, Store, StoreError, Volume
from cairnstore.streaming import ingest

KEYS = Keys(b"k" * 32)
KIB = 1 << 10


class Stop(Exception):
    pass


def noise(n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


def volumes(*thresholds):
    return tuple(Volume(f"v{k}", threshold=t) for k, t in enumerate(thresholds))


def make(spark, path, sealed=True, avg=64 * KIB, thresholds=(8 << 20,), **config):
    c = Config(avg_size=avg, volumes=volumes(*thresholds), sealed=sealed, **config)
    return Store.init(spark, str(path), KEYS if sealed else None, c)


def stop_at(point):
    def hook(at):
        if at == point:
            raise Stop(point)

    return hook


@pytest.mark.parametrize("sealed", [True, False])
def test_round_trip_and_dedup(spark, tmp_path, sealed):
    s = make(spark, tmp_path / "s", sealed, avg=4 * KIB)
    body = noise(300 * KIB + 137)
    first = s.put("a", body)
    assert first.committed and first.new_chunks == first.total_chunks and first.size == len(body)
    assert s.get("a") == body
    again = s.put("a", body)
    assert not again.committed and again.new_chunks == 0 and s.tip() == 0
    other = s.put("b", body)
    assert other.committed and other.new_chunks == 0 and other.deduped == other.total_chunks
    edited = s.put("c", body[: 150 * KIB] + b"\xaa" * KIB + body[150 * KIB :])
    assert edited.deduped >= 0.8 * edited.total_chunks
    assert [r["name"] for r in s.ls().collect()] == ["a", "b", "c"]
    assert s.segment_listing().count() == first.new_chunks + edited.new_chunks


def test_boundary_sizes_in_one_batch(spark, tmp_path):
    s = make(spark, tmp_path / "s", avg=4 * KIB)
    files = {f"f{n}": noise(n, n + 1) for n in (0, 1, 2, 2 * KIB - 1, 2 * KIB, 2 * KIB + 1, 4 * KIB, 16 * KIB, 16 * KIB + 1, 100_123)}
    done = s.put_batch(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, content binary"))
    assert done.committed and done.version == 0
    assert {n: s.get(n) for n in files} == files
    with pytest.raises(StoreError, match="once"):
        s.put_batch(spark.createDataFrame([("x", bytearray(b"1")), ("x", bytearray(b"2"))], "name string, content binary"))


def test_refusals(spark, tmp_path):
    s = make(spark, tmp_path / "s")
    s.put("a", noise(1000))
    for act, what in (
        (lambda: s.get("b"), "no file"),
        (lambda: s.remove("b"), "no file"),
        (lambda: s.get("a", at=9), "no version"),
        (lambda: make(spark, tmp_path / "s"), "already"),
        (lambda: Store.open(spark, str(tmp_path / "s"), None), "keyfile"),
        (lambda: Store.open(spark, str(tmp_path / "s"), KEYS, avg_size=KIB), "average"),
        (lambda: Store.open(spark, str(tmp_path / "t"), KEYS), "no store"),
        (lambda: Store.open(spark, str(tmp_path / "s"), Keys(b"x" * 32)).ls(), "doesn't open"),
    ):
        with pytest.raises(StoreError, match=what):
            act()
    assert s.tip() == 0
    with pytest.raises(ValueError):
        Store.init(spark, "ftp://host/x", KEYS)
    with pytest.raises(ValueError):
        Volume.parse("=x")


def test_only_empty_volumes_are_adopted(spark, tmp_path):
    (tmp_path / "s" / "volumes" / "v0").mkdir(parents=True)
    make(spark, tmp_path / "s")
    (tmp_path / "t" / "volumes" / "v0" / "seg=other").mkdir(parents=True)
    with pytest.raises(StoreError, match="empty"):
        make(spark, tmp_path / "t")


def test_corruption_is_loud(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False, avg=4 * KIB)
    s.put("a", noise(20 * KIB))
    rows = s.chunk_store()
    (vol, seg), = s.state().seals
    bad = rows.selectExpr("vol", "seg", "chunk_id", "plaintext_hash", "len", "clen", "concat(substring(ciphertext, 1, len - 1), X'00') AS ciphertext")
    bad.write.mode("overwrite").parquet(str(tmp_path / "bad"))
    s.files.delete(f"volumes/{vol}/seg={seg}")
    with pytest.raises(StoreError):
        s.get("a")
    spark.read.parquet(str(tmp_path / "bad")).write.parquet(s.files.path(f"volumes/{vol}/seg={seg}"))
    with pytest.raises(StoreError):
        s.get("a")


@pytest.mark.parametrize("point", ["before-segment", "after-segment", "before-cas", "after-cas"])
def test_a_put_that_dies_leaves_the_store_whole(spark, tmp_path, point):
    s = make(spark, tmp_path / "s")
    old, new = noise(100 * KIB, 1), noise(150 * KIB, 2)
    s.put("a", old)
    broken = Store(spark, str(tmp_path / "s"), KEYS, hook=stop_at(point))
    with pytest.raises(Stop):
        broken.put("b", new)
    names = [r["name"] for r in s.ls().collect()]
    assert names == (["a", "b"] if point == "after-cas" else ["a"]) and s.get("a") == old
    redo = s.put("b", new)
    assert redo.committed == (point != "after-cas") and s.get("b") == new


def test_racing_writers_lose_nothing(spark, tmp_path):
    s = make(spark, tmp_path / "s")
    bodies = {f"w{k}": noise(64 * KIB, 100 + k) for k in range(4)}
    failed = []

    def work(name):
        try:
            Store(spark, str(tmp_path / "s"), KEYS).put(name, bodies[name])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in bodies]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and s.tip() == 3
    assert {n: s.get(n) for n in bodies} == bodies


def test_snapshots_and_checkpoints(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False, avg=4 * KIB, checkpoint_interval=3)
    for k in range(7):
        s.put(f"f{k % 4}", noise(5000, 200 + k))
    s.remove("f1")
    kinds = [r["kind"] for r in s.log().collect()]
    assert kinds.count("checkpoint") >= 2 and len(kinds) == 8
    assert s.get("f0", at=0) == noise(5000, 200) and s.get("f0") == noise(5000, 204)
    assert [r["name"] for r in s.ls(at=1).collect()] == ["f0", "f1"]
    assert [r["name"] for r in s.ls().collect()] == ["f0", "f2", "f3"]
    datasource.register(spark)
    for at, share in ((None, 1 << 20), (None, 1000), (1, 1000), (6, 1 << 20), (7, 500)):
        read = spark.read.format("blobstore").option("share", share)
        read = read if at is None else read.option("versionAsOf", at)
        got = sorted(tuple(r)[:3] for r in read.load(str(tmp_path / "s")).collect())
        assert got == [tuple(r) for r in s.ls(at).collect()]


def test_budget_and_spread(spark, tmp_path):
    s = make(spark, tmp_path / "one", thresholds=(100 * KIB,))
    s.put("a", noise(30 * KIB, 1))
    with pytest.raises(BudgetExhausted):
        s.put("b", noise(200 * KIB, 2))
    assert s.tip() == 0 and [r["name"] for r in s.ls().collect()] == ["a"]
    s = make(spark, tmp_path / "three", thresholds=(8 << 20,) * 3)
    used = [s.put(f"f{k}", noise(200 * KIB, k)).volume for k in range(2)]
    assert used == ["v0", "v1"]
    assert {r["id"]: r["spare"] for r in s.stats().collect()} == {"v0": False, "v1": False, "v2": True}


@pytest.mark.parametrize("sealed", [True, False])
def test_a_put_that_no_volume_has_room_for_is_split(spark, tmp_path, sealed):
    s = make(spark, tmp_path / "s", sealed, avg=4 * KIB, thresholds=(150 * KIB, 200 * KIB, 1 << 20), checkpoint_interval=2)
    bodies = {"a": noise(200 * KIB, 21), "b": noise(100 * KIB, 22)}
    files = spark.createDataFrame([(n, bytearray(b)) for n, b in bodies.items()], "name string, content binary")
    done = s.put_batch(files)
    assert done.committed and done.volume == "v1,v0"
    used = s.state().used()
    # The first is filled to less than a chunk, none over its budget, and every chunk is where its manifest says, once.
    assert 184 * KIB < used["v1"] <= 200 * KIB and sum(used.values()) == done.new_bytes and used["v0"] <= 150 * KIB
    assert s.chunk_store().count() == s.segment_listing().count() == done.new_chunks
    assert {r["vol"]: r["n"] for r in s.chunk_store().groupBy("vol").agg(F.sum("clen").alias("n")).collect()} == used
    assert {n: s.get(n) for n in bodies} == bodies and not s.put_batch(files).committed
    with pytest.raises(BudgetExhausted):
        s.put("c", noise(60 * KIB, 23))
    assert s.tip() == 0
    # What is left of a split segment moves like any other's.
    s.remove("a")
    assert sorted(r["volume"] for r in s.compact(Gates(), force=True)["compacted"]) == ["v0", "v1"]
    assert s.get("b") == bodies["b"] and set(s.state().used()) == {"v2"}


def words(n, seed=1):
    """Text that compresses to about half."""
    rows = np.random.default_rng(seed).integers(0, 16, n // 2, dtype=np.uint8)
    return rows.tobytes().hex().encode()[:n]


def test_a_plain_budget_bounds_what_is_stored(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False, avg=4 * KIB, thresholds=(100 * KIB, 100 * KIB, 1 << 20), checkpoint_interval=2)
    bodies = {"a": words(180 * KIB, 1), "b": words(180 * KIB, 2), "c": noise(20 * KIB, 3)}
    done = [s.put(n, b) for n, b in bodies.items()]
    assert [d.new_bytes for d in done] == [180 * KIB, 180 * KIB, 20 * KIB] and [d.volume for d in done] == ["v0", "v1", "v0"]
    # The index and the listing count chunks as they were cut; budgets and utilization what is stored.
    assert s.state().used() == {"v0": 200 * KIB, "v1": 180 * KIB}
    kept = {r["vol"]: r["n"] for r in s.chunk_store().groupBy("vol").agg(F.sum(F.octet_length("ciphertext")).alias("n")).collect()}
    assert s.state().held() == kept and max(kept.values()) <= 100 * KIB
    assert s.segment_listing().agg(F.sum("bytes")).first()[0] == 380 * KIB
    assert [r["utilization"] for r in s.stats().collect()] == [kept["v0"] / (100 * KIB), kept["v1"] / (100 * KIB), 0.0]
    with pytest.raises(BudgetExhausted):
        s.put("d", noise(60 * KIB, 4))
    s.remove("a")
    assert [r["volume"] for r in s.compact(Gates(), force=True)["compacted"]] == ["v0"]
    assert 20 * KIB == s.state().held()["v2"] and s.get("b") == bodies["b"] and s.get("c") == bodies["c"]
    assert s.put("a", bodies["a"]).volume == "v0" and s.get("a") == bodies["a"]


def test_a_plain_chunk_that_was_changed_is_loud(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False, avg=4 * KIB)
    s.put("a", words(3 * KIB) + noise(40 * KIB))
    (vol, seg), = s.state().seals
    s.chunk_store().write.parquet(f"{tmp_path}/whole")
    whole = spark.read.parquet(f"{tmp_path}/whole")
    at = f"{tmp_path}/s/volumes/{vol}/seg={seg}"
    for cut in ("ciphertext || X'00'", "substring(ciphertext, 1, octet_length(ciphertext) - 9)", "concat(substring(ciphertext, 1, octet_length(ciphertext) - 1), X'00')", "X''"):
        whole.withColumn("ciphertext", F.expr(cut)).write.mode("overwrite").parquet(at)
        with pytest.raises(StoreError, match="another length|doesn't open|doesn't have its id"):
            s.get("a")
    whole.write.mode("overwrite").parquet(at)
    assert s.get("a") == words(3 * KIB) + noise(40 * KIB)


def test_plain_segments_of_before_are_read(spark, tmp_path):
    """Chunks that aren't compressed, and records that don't say what is stored."""
    import json

    s = make(spark, tmp_path / "s", sealed=False, avg=4 * KIB)
    body = words(50 * KIB)
    s.put("a", body)
    (vol, seg), = s.state().seals
    raw = s.chunk_store().join(s.read().select("data", F.sha2("data", 256).alias("chunk_id")), "chunk_id")
    raw = raw.select("vol", "seg", "chunk_id", "plaintext_hash", "len", "clen", F.col("data").alias("ciphertext"))
    raw.write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    assert raw.count() == s.chunk_store().count()
    raw.write.mode("overwrite").parquet(f"{tmp_path}/s/volumes/{vol}/seg={seg}")
    record = tmp_path / "s" / "log" / f"{0:020d}.json"
    old = json.loads(record.read_text())
    del old["seals"][0]["stored"]
    record.write_text(json.dumps(old))
    (tmp_path / "s" / "log" / f".{0:020d}.json.crc").unlink(missing_ok=True)
    assert s.get("a") == body and s.state().held() == s.state().used() == {"v0": 50 * KIB}


def test_many_names_are_joined_not_literals(spark, tmp_path, monkeypatch):
    s = make(spark, tmp_path / "s", avg=4 * KIB)
    s.put_batch(spark.sql("SELECT concat('f', id) AS name, CAST(concat('body ', id) AS BINARY) AS content FROM range(300)"))
    kind, most = type(F.col("name")), []
    whole = kind.isin
    monkeypatch.setattr(kind, "isin", lambda self, *x: most.append(len(x[0])) or whole(self, *x))
    gone = [f"f{k}" for k in range(298)]
    assert s.read(gone).count() == 298
    with pytest.raises(StoreError, match="'f300'"):
        s.remove(*gone, "f300")
    assert s.tip() == 0 and s.remove(*gone, gone[0]) == 1
    assert max(most, default=0) <= 100
    assert [r["name"] for r in s.ls().collect()] == ["f298", "f299"] and s.get("f299") == b"body 299"


def filled(spark, path, **more):
    s = make(spark, path, thresholds=(1 << 20, 32 * KIB, 8 << 20), avg=16 * KIB, **more)
    for k in range(4):
        s.put(f"f{k}", noise(100 * KIB, 10 + k))
    s.remove("f0", "f1", "f2")
    return s


def test_compaction_reclaims_and_gates_hold(spark, tmp_path):
    s = filled(spark, tmp_path / "s")
    assert s.compact(Gates())["compacted"] == []
    pinned = s.tip()
    report = s.compact(Gates(), force=True)
    assert [(r["volume"], r["dest_volume"]) for r in report["compacted"]] == [("v0", "v2")]
    assert s.get("f3") == noise(100 * KIB, 13)
    stats = {r["id"]: r for r in s.stats().collect()}
    assert stats["v0"]["total"] == 0 and stats["v2"]["dead"] == 0 and stats["v2"]["live"] > 0
    assert s.compact(Gates(), force=True)["compacted"] == []
    with pytest.raises(StoreError):
        s.get("f0", at=pinned - 1)
    assert s.put("f4", noise(50 * KIB, 50)).volume == "v0"


@pytest.mark.parametrize("point", ["compact-after-rewrite", "compact-before-cas", "compact-after-cas", "compact-before-delete"])
def test_a_compaction_that_dies_loses_nothing(spark, tmp_path, point):
    filled(spark, tmp_path / "s")
    broken = Store(spark, str(tmp_path / "s"), KEYS, hook=stop_at(point))
    with pytest.raises(Stop):
        broken.compact(Gates(), force=True)
    s = Store(spark, str(tmp_path / "s"), KEYS)
    assert s.get("f3") == noise(100 * KIB, 13)
    s.compact(Gates(), force=True)
    assert s.get("f3") == noise(100 * KIB, 13) and s.put("f5", noise(1000, 9)).committed


def interrupted(spark, path, point, action):
    """A store whose first put does something else at a point of its course."""
    once = []

    def hook(at):
        if at == point and not once:
            once.append(at)
            action(Store(spark, str(path), KEYS))

    return Store(spark, str(path), KEYS, hook=hook), once


@pytest.mark.parametrize("point", ["before-segment", "after-segment", "before-cas"])
def test_a_put_over_a_retired_volume_starts_again(spark, tmp_path, point):
    filled(spark, tmp_path / "s")
    body = noise(100 * KIB, 13)
    s, once = interrupted(spark, tmp_path / "s", point, lambda x: x.compact(Gates(), force=True))
    assert s.put("copy", body).committed and once
    assert s.get("copy") == body and s.get("f3") == body


@pytest.mark.parametrize("point", ["before-segment", "after-segment", "before-cas"])
def test_a_put_over_a_swept_segment_starts_again(spark, tmp_path, point):
    s = make(spark, tmp_path / "s")
    body = noise(200 * KIB, 7)
    s.put("old", body)

    def sweep(x):
        x.remove("old")
        assert x.compact(Gates(orphan_window=0))["orphans_swept"] >= 1

    s, once = interrupted(spark, tmp_path / "s", point, sweep)
    done = s.put("late", body)
    assert done.committed and once and done.new_chunks == done.total_chunks and s.get("late") == body
    fresh, once = interrupted(spark, tmp_path / "s", point, lambda x: x.compact(Gates(orphan_window=0)))
    assert fresh.put("new", noise(90 * KIB, 8)).committed and once
    assert fresh.get("new") == noise(90 * KIB, 8) and fresh.get("late") == body


def test_a_sweep_waits_for_its_record(spark, tmp_path):
    s = make(spark, tmp_path / "s")
    body = noise(100 * KIB, 7)
    s.put("old", body)
    s.remove("old")
    late, once = interrupted(spark, tmp_path / "s", "before-sweep", lambda x: x.put("again", body))
    assert late.compact(Gates(orphan_window=0))["orphans_swept"] == 1 and once
    assert s.get("again") == body
    assert {r["id"]: r["dead"] for r in s.stats().collect()} == {"v0": 0}


def test_a_put_after_a_volume_is_retired_survives_its_emptying(spark, tmp_path):
    filled(spark, tmp_path / "s")
    body = noise(80 * KIB, 21)
    s, once = interrupted(spark, tmp_path / "s", "compact-before-delete", lambda x: x.put("late", body))
    s.compact(Gates(), force=True)
    assert once and s.get("late") == body and s.get("f3") == noise(100 * KIB, 13)


def test_the_interval_blocks_a_second_compaction(spark, tmp_path):
    now = [1_000_000]
    s = filled(spark, tmp_path / "s")
    s.clock = lambda: now[0]
    gates = Gates(pressure=0.3, min_interval=100)
    assert len(s.compact(gates)["compacted"]) == 1
    for k in range(4):
        s.put(f"g{k}", noise(100 * KIB, 60 + k))
    s.remove("g0", "g1", "g2")
    assert s.compact(gates)["compacted"] == []
    assert len(s.compact(gates, force=True)["compacted"]) == 1
    now[0] += 100
    assert [r["kind"] for r in s.log().collect()].count("compact") == 2


def test_a_sealed_store_shows_nothing(spark, tmp_path):
    s = make(spark, tmp_path / "s", avg=4 * KIB, checkpoint_interval=3)
    needle = b"A-NEEDLE-THAT-IS-EASY-TO-FIND"
    for k in range(4):
        s.put(f"secrets-{k}.txt", needle * 2000 + bytes([k]))
    hashes = [r["plaintext_hash"] for r in s.refs().collect()]
    found = [p for p in (tmp_path / "s").rglob("*") if p.is_file()]
    assert len(found) > 5
    for p in found:
        body = p.read_bytes()
        assert needle not in body and b"secrets" not in body and not any(h.encode() in body for h in hashes), p
    assert s.get("secrets-2.txt") == needle * 2000 + b"\x02"


def test_a_shared_chunk_lives_until_its_last_file_goes(spark, tmp_path):
    s = make(spark, tmp_path / "s")
    s.put("a", noise(200 * KIB, 55))
    before = s.stats().first()
    assert s.put("b", noise(200 * KIB, 55)).new_chunks == 0
    s.remove("a")
    after = s.stats().first()
    assert (after["total"], after["live"], after["dead"]) == (before["total"], before["live"], 0)
    s.remove("b")
    last = s.stats().first()
    assert last["live"] == 0 and last["dead"] == last["total"] == before["total"]


def test_orphans_wait_for_the_window(spark, tmp_path):
    s = make(spark, tmp_path / "s")
    with pytest.raises(Stop):
        Store(spark, str(tmp_path / "s"), KEYS, hook=stop_at("before-cas")).put("a", noise(32 * KIB))
    assert s.compact(Gates(orphan_window=100_000))["orphans_swept"] == 0
    assert s.compact(Gates(orphan_window=0))["orphans_swept"] == 1
    assert s.put("a", noise(32 * KIB)).committed and s.get("a") == noise(32 * KIB)


def test_a_split_segment_is_swept_as_one(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False, avg=4 * KIB, thresholds=(60 * KIB, 60 * KIB))
    with pytest.raises(Stop):
        Store(spark, str(tmp_path / "s"), None, hook=stop_at("before-cas")).put("a", noise(100 * KIB))
    assert s.chunk_store().select("vol").distinct().count() == 2
    assert s.compact(Gates(orphan_window=0))["orphans_swept"] == 1
    assert s.chunk_store().isEmpty() and s.put("a", noise(100 * KIB)).committed and s.get("a") == noise(100 * KIB)


def test_mirror(spark, tmp_path):
    s = make(spark, tmp_path / "s", thresholds=(8 << 20, 8 << 20))
    for k in range(3):
        s.put(f"f{k}", noise(60 * KIB, k + 1))
    target = str(tmp_path / "m")
    with pytest.raises(StoreError, match="no target"):
        s.mirror(target, {"v0": target})
    assert s.mirror(target, {"v0": target, "v1": target}) > 0
    assert s.mirror(target, {"v0": target, "v1": target}) == 0
    s.put("g", noise(10 * KIB, 9))
    s.mirror(target, {"v0": target, "v1": target})
    copy = Store(spark, target, KEYS)
    assert copy.tip() == s.tip() and {n: copy.get(n) for n in ("f0", "g")} == {"f0": noise(60 * KIB, 1), "g": noise(10 * KIB, 9)}


def test_tokens_make_a_batch_idempotent(spark, tmp_path):
    s = make(spark, tmp_path / "s")
    df = spark.createDataFrame([("a", bytearray(b"1" * 5000))], "name string, content binary")
    assert s.put_batch(df, token="q-1").committed and not s.put_batch(df, token="q-1").committed
    s.files.delete("tokens/q-1")
    assert not s.put_batch(df, token="q-1").committed and s.tip() == 0


def test_streams(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False, avg=4 * KIB)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.bin").write_bytes(noise(9000, k))
    twice = spark.createDataFrame([("x", bytearray(b"old"), 1), ("x", bytearray(b"new"), 2), ("y", bytearray(b"b"), 1), ("y", bytearray(b"a"), 1)], "name string, content binary, modified long")
    order = ingest.last_of_each(twice).orderBy("name").collect()
    assert [bytes(r["content"]) for r in order] == [b"new", max(b"a", b"b", key=lambda b: hashlib.sha256(b).hexdigest())]
    files = ingest.folder(spark, str(tmp_path / "in"), per_trigger=2)
    ingest.ingest(files, s, str(tmp_path / "check"), "load", once=True).awaitTermination(120)
    assert {n: s.get(f"f{n}.bin") for n in range(3)} == {n: noise(9000, n) for n in range(3)} and s.tip() == 1
    datasource.register(spark)
    tail = spark.readStream.format("blobstore").option("tail", "true").load(str(tmp_path / "s"))
    q = tail.writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "t")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["version"] for r in spark.table("tail").collect()) == [0, 1]


def test_a_stream_fills_volumes_together(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False, avg=4 * KIB, thresholds=(100 * KIB, 100 * KIB, 1 << 20))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.bin").write_bytes(noise(60 * KIB, 30 + k))
    files = ingest.folder(spark, str(tmp_path / "in"), per_trigger=1)
    ingest.ingest(files, s, str(tmp_path / "check"), "load", once=True).awaitTermination(120)
    used = s.state().used()
    assert s.tip() == 2 and sum(used.values()) == 180 * KIB and max(used.values()) <= 100 * KIB and "v2" not in used
    assert {n: s.get(f"f{n}.bin") for n in range(3)} == {n: noise(60 * KIB, 30 + n) for n in range(3)}


def test_a_stream_is_bounded_by_what_is_stored(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False, avg=4 * KIB, thresholds=(100 * KIB, 100 * KIB, 1 << 20))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.bin").write_bytes(words(90 * KIB, 30 + k))
    files = ingest.folder(spark, str(tmp_path / "in"), per_trigger=1)
    ingest.ingest(files, s, str(tmp_path / "check"), "load", once=True).awaitTermination(120)
    assert s.tip() == 2 and sum(s.state().used().values()) == 270 * KIB and max(s.state().held().values()) <= 100 * KIB
    assert {n: s.get(f"f{n}.bin") for n in range(3)} == {n: words(90 * KIB, 30 + n) for n in range(3)}


def test_throttle(spark, tmp_path):
    import time

    c = Config(avg_size=64 * KIB, volumes=(Volume("v0", push_interval_ms=1500),), sealed=False)
    s = Store.init(spark, str(tmp_path / "s"), None, c)
    began = time.monotonic()
    for k in range(3):
        s._throttle("v0")
    assert time.monotonic() - began >= 2.9


def test_gates_from_the_environment(monkeypatch):
    monkeypatch.setenv("STORE_PRESSURE", "0.5")
    monkeypatch.setenv("STORE_MIN_INTERVAL", "soon")
    assert Gates.from_env() == Gates(pressure=0.5)


def test_rate_limited_writes_back_off(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False)
    waits, errors = [], [OSError("HTTP 429"), OSError("Secondary Rate Limit")]

    def write():
        if errors:
            raise errors.pop()

    s._pushed("v0", write, waits.append)
    assert len(waits) == 2 and 0.5 <= waits[0] < 0.75 and 1.0 <= waits[1] < 1.25
    with pytest.raises(OSError, match="broken"):
        s._pushed("v0", lambda: (_ for _ in ()).throw(OSError("broken pipe")), waits.append)
    assert len(waits) == 2


def test_a_listing_is_shared_out_by_the_columns_it_reads(spark, tmp_path):
    s = make(spark, tmp_path / "s", sealed=False, avg=KIB)
    s.put("a", noise(600 * KIB))
    s.put("b", b"")
    log = datasource._Log(s.files.root)
    at = [log.record(v)["manifests"] for v in log.versions()]
    # Half a megabyte of ids of some hundred chunks would be bytes of manifests, but not of a listing.
    assert log.weight(at[0]) < sum(f.stat().st_size for f in (tmp_path / "s" / at[0]).rglob("*.parquet")) / 4
    got = dict(x for name in at for part in range(3) for x in log.manifests(name, part, 3))
    assert {n: r[:2] for n, r in got.items()} == {r["name"]: (r["size"], r["n_chunks"]) for r in s.ls().collect()}
