"""Embedding near-duplicates by spherical-cap filters.

Filter directions come from structured random product codes: the randomly
rotated space is cut into two halves, each with random unit codewords of its own,
and a direction is a pair of them. A vector is decoded to the list of all
directions whose product with it exceeds a threshold, without visiting the
others: a codeword of the first half is looked at only if the best of the second
could lift it above. Vectors are joined on filters and verified in double
precision.

There are many such codes, each with its own rotation. Their size and number follow
from the number of vectors of a length: the threshold is the exact spherical cap
that a random vector is in with a chance of `bucket` / n, and as the codes are
independent, a link is missed with the chance of one code to the power of their
number. That chance is measured on pairs at the very similarity asked for, through
codes of the size in use, and there are as many codes as bring it under `miss`.
A vector without any filter gets the best direction of each code. Vectors of fewer
than `SPACE` components are padded with zeros, which leaves cosines as they are.

A linked pair is counted in the smallest filter that both have, so pairs are
never listed: a bucket returns how many links each of its vectors has there and
a spanning forest. Equal vectors are one class from the start. A large bucket is
cut into blocks, and pairs of blocks are units of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_tools import broadcast_if_small, components, materialize, partitions

#: Expected random vectors in a bucket, and the chance of a miss that the codes are sized for.
BUCKET, MISS = 48, 1e-4
#: Codes at most before their codewords are increased instead: low similarities need many directions.
CODES = 128
#: Least dimension of a code.
SPACE = 16
#: Vectors of a bucket compared at once; larger buckets are cut.
BLOCK = 2048
SMALL = 100_000


def usable(vector: str = "embedding") -> Column:
    """Whether a vector can link: not null or empty, all components finite, not all zero."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0), F.lit(False))


def cap(dim: int, p: float) -> float:
    """The least product with a direction that a random unit vector reaches with chance p."""
    angle = np.linspace(0, math.pi, 200_001)
    with np.errstate(divide="ignore"):
        density = np.exp((dim - 2) * np.log(np.sin(angle).clip(0)))
    below = np.cumsum(density)
    return math.cos(float(np.interp(p, below / below[-1], angle)))


def missed(dim: int, cosine: float, words: int, least: float) -> float:
    """Chance that a random pair at this cosine has no filter of one code in common: measured, with two deviations more."""
    rng = np.random.default_rng([dim, words])
    trials, pairs = 64, 128
    rates = []
    for k in range(trials):
        x, y = rng.standard_normal((2, pairs, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y *= math.sqrt(max(0.0, 1 - cosine * cosine)) / np.linalg.norm(y, axis=1, keepdims=True)
        rows, found = Code(dim, words, 1, k).decode(np.concatenate([x, cosine * x + y]), least)
        both, times = np.unique((rows % pairs) * words**2 + found, return_counts=True)
        rates.append(1 - len(np.unique(both[times > 1] // words**2)) / pairs)
    return float(np.mean(rates) + 2 * np.std(rates) / math.sqrt(trials))


def sizes(n: int, cosine: float, dim: int, bucket: float = BUCKET, miss: float = MISS) -> tuple[float, int, int]:
    """For n vectors of a length: threshold, codewords for each half of a code, and number of codes."""
    space = max(dim, SPACE)
    p = min(0.02, bucket / max(n, 1))
    least, per = cap(space, p), 1.0
    while True:
        words = max(2, math.ceil(math.sqrt(per / p)))
        rate = min(max(missed(space, cosine, words, least), 1e-4), 1 - 1e-6)
        codes = math.ceil(math.log(miss) / math.log(rate))
        if codes <= CODES or words > 1 << 13:
            return least, words, codes
        per *= 2


class Code:
    """A product code for one dimension."""

    def __init__(self, dim: int, words: int, seed: int, number: int):
        rng = np.random.default_rng([seed, dim, words, number])
        self.half, self.words = dim // 2, words
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        parts = [rng.standard_normal((words, self.half)), rng.standard_normal((words, dim - self.half))]
        self.parts = [p / np.linalg.norm(p, axis=1, keepdims=True) for p in parts]

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = x @ self.turn
        return turned[:, : self.half] @ self.parts[0].T, turned[:, self.half :] @ self.parts[1].T

    def best(self, x: np.ndarray) -> np.ndarray:
        """The filter of the direction nearest to each vector."""
        first, second = self.products(x)
        return first.argmax(axis=1).astype(np.int64) * self.words + second.argmax(axis=1)

    def decode(self, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for every direction whose product with a unit vector is `least` or more."""
        first, second = self.products(x)
        least = least * math.sqrt(2)
        rows, i = np.nonzero(first + second.max(axis=1, keepdims=True) >= least)
        found_rows, found = [], []
        for a in range(0, len(rows), 1 << 13):
            r, k = rows[a : a + (1 << 13)], i[a : a + (1 << 13)]
            at, j = np.nonzero(first[r, k][:, None] + second[r] >= least)
            found_rows.append(r[at])
            found.append(k[at].astype(np.int64) * self.words + j)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_rows), np.concatenate(found)


def _unit(raw: bytes, kind: type) -> np.ndarray:
    x = np.frombuffer(raw, kind).astype(np.float64)
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def filters_of(unit: np.ndarray, codes: list[Code], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, code << 32 | filter) of unit vectors over all codes; a vector that exceeds nowhere has each code's best."""
    room = codes[0].turn.shape[0] - unit.shape[1]
    if room:
        unit = np.pad(unit, ((0, 0), (0, room)))
    decoded = [code.decode(unit, least) for code in codes]
    rows = np.concatenate([r for r, _ in decoded])
    found = np.concatenate([f + (k << 32) for k, (_, f) in enumerate(decoded)])
    bare = np.flatnonzero(np.bincount(rows, minlength=len(unit)) == 0)
    if len(bare):
        rows = np.concatenate([rows, np.tile(bare, len(codes))])
        found = np.concatenate([found, *(code.best(unit[bare]) + (k << 32) for k, code in enumerate(codes))])
    return rows, found


def filtered(classes: DataFrame, layout: dict[int, tuple[float, int, int]], seed: int, only: bool = False) -> DataFrame:
    """(filter, class, copies, lists, vector) for each class and each of its filters; lists are its smaller filters.

    layout: the sizes for each length of vectors.
    Vectors are the bytes of their components in their own precision. With `only`, the filters alone.
    """
    single = classes.schema["embedding"].dataType.elementType.typeName() == "float"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[Code]] = {}
        for batch in batches:
            vectors = batch.column(2)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dim in np.unique(lengths).tolist():
                least, words, number = layout[dim]
                if dim not in codes:
                    codes[dim] = [Code(max(dim, SPACE), words, seed, k) for k in range(number)]
                chosen = np.flatnonzero(lengths == dim)
                for a in range(0, len(chosen), 2048):
                    part = chosen[a : a + 2048]
                    x = flat[starts[part][:, None] + np.arange(dim)]
                    scaled = x / np.abs(x).max(axis=1, keepdims=True)
                    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                    rows, found = filters_of(unit, codes[dim], least)
                    found = found + (dim << 44)
                    if only:
                        yield pa.RecordBatch.from_arrays([pa.array(found)], names=["filter"])
                        continue
                    order = np.lexsort((found, rows))
                    rows, found = rows[order], found[order]
                    starts_at = np.searchsorted(rows, rows)
                    lists = [found[s:e].tobytes() for e, s in enumerate(starts_at.tolist())]
                    bodies = [row.tobytes() for row in (x.astype(np.float32) if single else x)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found),
                            batch.column(0).take(pa.array(part[rows])),
                            batch.column(1).take(pa.array(part[rows])),
                            pa.array(lists, pa.binary()),
                            pa.array([bodies[k] for k in rows], pa.binary()),
                        ],
                        names=["filter", "class", "copies", "lists", "vector"],
                    )

    schema = "filter long" + ", class long, copies long, lists binary, vector binary" * (not only)
    return classes.select("class", "copies", "embedding").mapInArrow(decode, schema)


def _compare(f: int, rows: list[tuple], sides: np.ndarray | None, cosine: float, kind: type) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each vector in a unit that no smaller filter has, weighed by copies, and a spanning forest of them.

    sides: which of two blocks each row is of, if the unit is a pair of blocks.
    """
    x = np.stack([_unit(r[4], kind) for r in rows])
    copies = np.array([r[2] for r in rows], np.int64)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if sides is not None:
        linked &= sides[:, None] != sides[None, :]
    if linked.any():
        lists = [np.frombuffer(r[3], np.int64) for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(v) for v in lists])
        flat = np.concatenate(lists)
        owner, flat = owner[flat < f], flat[flat < f]
        _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
        keep = times[back] > 1
        columns = np.unique(back[keep], return_inverse=True)[1]
        for a in range(0, int(columns.max()) + 1 if len(columns) else 0, 2048):
            some = (columns >= a) & (columns < a + 2048)
            shared = np.zeros((len(rows), 2048), np.float32)
            shared[owner[keep][some], columns[some] - a] = 1
            linked &= shared @ shared.T == 0
    forest = []
    label = np.arange(len(rows))
    for i in range(len(rows)):
        others = np.flatnonzero(linked[i, :i])
        for j in others[np.unique(label[others], return_index=True)[1]].tolist() if len(others) else []:
            if label[i] != label[j]:
                forest.append((i, j))
                label[label == label[j]] = label[i]
    return linked @ copies, forest


def _keys() -> list[Column]:
    """Two hashes by which rows find the class of their vector."""
    size = F.size("embedding")
    return [F.xxhash64("embedding", size).alias("_key"), F.xxhash64(F.lit(1), size, "embedding").alias("_check")]


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, seed: int = 0) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept (vec_id = component_id).

    Vectors of one length link if their cosine in double precision is at least
    `cosine`; n_links counts the other rows linked directly. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, and so do
    rows with a null vec_id (component_id null, kept false). Equal vectors always
    link. Rows that share a vec_id count as rows of their own. Extra columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", (usable() & F.col("vec_id").isNotNull()).alias("_ok"))
    good = rows.where("_ok")
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("class"), *_keys(), "least", "copies", "embedding"))
    counts = classes.groupBy(F.size("embedding").alias("length")).count().collect()
    layout = {r["length"]: sizes(r["count"], cosine, r["length"]) for r in counts}
    kind = np.float32 if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    spread = filtered(classes, layout, seed)
    large = filtered(classes, layout, seed, only=True).groupBy("filter").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    large = materialize(large.select(F.col("filter").alias("_f"), F.ceil(F.col("_n") / (BLOCK / 2)).cast("int").alias("_blocks")))
    dealt = spread.join(broadcast_if_small(large, large.count(), SMALL), F.col("filter") == F.col("_f"), "left")
    own = F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("class"), F.col("_blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)
    dealt = dealt.withColumn("_own", own).withColumn("_other", F.explode(others))
    dealt = dealt.select(
        "filter",
        F.least("_own", "_other").alias("p"),
        F.greatest("_own", "_other").alias("q"),
        (F.col("_own") > F.col("_other")).cast("byte").alias("side"),
        "class",
        "copies",
        "lists",
        "vector",
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now: tuple | None = None
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(held) < 2:
                return
            sides = np.array([r[5] for r in held]) if now[1] != now[2] else None
            counts, forest = _compare(now[0], held, sides, cosine, kind)
            for k in np.flatnonzero(counts).tolist():
                for column, value in zip(out, (held[k][1], int(counts[k]), None), strict=True):
                    column.append(value)
            for i, j in forest:
                for column, value in zip(out, (held[i][1], 0, held[j][1]), strict=True):
                    column.append(value)

        def batch_out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["class", "links", "other"])

        for batch in batches:
            for f, p, q, side, cls, copies, lists, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (f, p, q) != now:
                    close()
                    held, now = [], (f, p, q)
                    if len(out[0]) > 50_000:
                        yield batch_out()
                        out = ([], [], [])
                held.append((f, cls, copies, lists, vector, side))
        close()
        yield batch_out()

    spread_out = dealt.repartition(partitions(spark), "filter", "p", "q").sortWithinPartitions("filter", "p", "q", "side", "class")
    found = materialize(spread_out.mapInArrow(verify, "class long, links long, other long"))
    links = found.groupBy("class").agg(F.sum("links").alias("_links"))
    linked = components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    named = classes.select("class", "_key", "_check", "least", "copies").join(linked, F.col("class") == F.col("node"), "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("least").alias("_of_all"))
    named = named.join(least, "component", "left").join(links, "class", "left")
    named = named.select(
        "_key",
        "_check",
        (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("_of_all", "least").alias("component_id"),
    )
    out = good.select("vec_id", *_keys()).join(named, ["_key", "_check"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("_ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
