"""python -m cairnstore ROOT VERB ...: init, put, get, ls, tip, stats, rm, compact, mirror."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import files
from .functions import parsing, sealing
from .store import DEFAULT_THRESHOLD, Config, Store, StoreError, Volume


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairnstore")
    p.add_argument("root")
    p.add_argument("--keyfile", help="64 hexadecimal digits; without it the store is plain")
    verbs = p.add_subparsers(dest="verb", required=True)
    init = verbs.add_parser("init")
    init.add_argument("--volume", action="append", required=True, help="ID=URL")
    init.add_argument("--chunk-size", default="1m")
    init.add_argument("--threshold", type=int, default=DEFAULT_THRESHOLD)
    put = verbs.add_parser("put")
    put.add_argument("file", nargs="+")
    get = verbs.add_parser("get")
    get.add_argument("name")
    get.add_argument("--output")
    for v in (get, verbs.add_parser("ls"), verbs.add_parser("stats")):
        v.add_argument("--at", type=int)
    verbs.add_parser("tip")
    rm = verbs.add_parser("rm")
    rm.add_argument("name", nargs="+")
    verbs.add_parser("compact").add_argument("--force", action="store_true")
    mirror = verbs.add_parser("mirror")
    mirror.add_argument("index")
    mirror.add_argument("--volume", action="append", default=[], help="ID=URL")
    return p


def run(spark: SparkSession, args: list[str]) -> int:
    a = _parser().parse_args(args)
    try:
        return _run(spark, a)
    except (StoreError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    keys = sealing.load_keyfile(a.keyfile, create=a.verb == "init") if a.keyfile else None
    if a.verb == "init":
        size = spark.range(1).select(parsing.chunk_size(F.lit(a.chunk_size))).first()[0]
        if size is None:
            raise ValueError(f"not a chunk size: {a.chunk_size!r}")
        volumes = tuple(Volume(v.id, v.url, threshold=a.threshold) for v in map(Volume.parse, a.volume))
        Store.init(spark, a.root, keys, Config(avg_size=size, volumes=volumes, sealed=keys is not None))
        return 0
    store = Store.open(spark, a.root, keys)
    if a.verb == "put":
        done = store.put_batch(files.load(spark, a.file))
        if done.committed:
            print(f"{done.total_chunks} chunks, {done.new_chunks} new, {done.deduped} deduped, {done.new_bytes} bytes")
        else:
            print("no changes")
    elif a.verb == "get":
        with Path(a.output or a.name).open("wb") as f:
            store.get(a.name, a.at, f)
    elif a.verb == "ls":
        rows = store.ls(a.at).collect()
        print("\n".join(f"{r['name']}\t{r['size']}\t{r['n_chunks']}" for r in rows) or "store is empty")
    elif a.verb == "tip":
        tip = store.tip()
        print("(empty log)" if tip is None else tip)
    elif a.verb == "stats":
        for r in store.stats(a.at).collect():
            shares = f"{round(100 * r['utilization'])}% used, {round(100 * r['dead_ratio'])}% dead"
            print(f"{r['id']}\t{r['total']} total\t{r['live']} live\t{r['dead']} dead\t{shares}{' (spare)' if r['spare'] else ''}")
    elif a.verb == "rm":
        store.remove(*a.name)
    elif a.verb == "compact":
        report = store.compact(force=a.force)
        for c in report["compacted"]:
            print(f"{c['volume']} -> {c['dest_volume']}: {c['chunks_moved']} chunks, {c['bytes_before']} bytes reclaimed")
        if not report["compacted"]:
            print("no volume eligible")
        print(f"{report['orphans_swept']} orphans swept")
    elif a.verb == "mirror":
        targets = {v.id: v.url for v in map(Volume.parse, a.volume)}
        print(f"{store.mirror(a.index, targets)} files copied")
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(run(session, sys.argv[1:]))
