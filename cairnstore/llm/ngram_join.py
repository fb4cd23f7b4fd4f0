"""N-gram Jaccard join by rare-first prefix filtering.

Documents are sets of word k-grams. Documents of one set are one class from the
start, so exact copies cost nothing later. A class is known by 128 bits; n-grams
meet by one 64-bit fingerprint and are verified by another, independent one.

1.  Signatures: each document's set size and class, and fixed-size count sketches of
    the corpus' n-grams and words, which give one global order: n-grams that stand out
    of their sketch last, the others by how rare their words are. So n-grams that
    texts share by chance are beyond the prefixes, however large the corpus.
2.  Prefixes: two sets as similar as asked share an n-gram within their prefixes in
    that order. Entries (n-gram, class, set size, place in the order) that are alone
    at their n-gram, or fit with none of the few others there, are dropped. What one
    task sees too often is spread by class and needs only a marker at its n-gram, so
    no n-gram gathers its rows in a task.
3.  Leaders: the entries of an n-gram are paired with two of them, the same two in
    every n-gram that they share. That is all pairs of up to three classes, and one
    or two pairs for each entry of a crowd; copies of one text end in one component.
4.  What is left are n-grams where more than three classes of several components
    meet. Up to CROWD of them are paired. In larger crowds pairs are listed too, of
    PAIRED classes at most, and those that all filters pass tie their ends together;
    still larger crowds are chained by length. What hangs together is cut into blocks
    of bounded size by length; each pair of blocks whose lengths allow it is one unit
    of work, in which pairs of different components are counted through an inverted
    index. So long texts that only share n-grams by chance don't meet in blocks.

A pair is made at an n-gram only if the set sizes beyond its places there allow the
overlap (length and positional filter; a link passes at its first common n-gram). It
is dropped if the counts by parts of the n-gram space, as many parts as a quarter of
the n-grams, leave no room for the overlap (suffix filter with fixed pivots). Each
remaining pair is verified once, in units of one set against a bounded number.

Components of the links are the groups. Links between components are never lost: the
prefix argument holds for any global order, all filters are bounds, and no bucket,
cluster or candidate list is capped. Links inside a component needn't all be looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_tools import broadcast_if_small, components, materialize, partitions, row_numbers
from .wordhash import fresh_memory, mix, mix_other, release_memory, shingle_sets, weighed_sets

#: Counters of the order's sketch: 2 ** SKETCH_BITS, one byte each when broadcast.
SKETCH_BITS = 20
#: Counters of the words' sketch, as many bytes behind the n-grams'.
WORD_BITS = 18
_CHUNK = 1 << 12
#: Prefix entries held by a task before it passes them on.
HELD = 1 << 18
#: More documents than this at one n-gram are a crowd.
CROWD = 16
#: In a crowd of so many at most pairs are listed to see what hangs together; the pairs listed at one n-gram are at most half the square.
PAIRED = 512
#: Sets that are verified against one other in a unit, about.
UNIT = 256
#: Documents and n-grams in a block at most (a longer document is a block of its own).
BLOCK_DOCS, BLOCK_NGRAMS = 512, 1 << 20
#: So many classes at most are broadcast to the scan that fetches their texts.
SMALL = 400_000
_STEP = 1 << 21
_ENTRY = "deal long, h long, high long, low long, n long, at int, crowd byte"


def _class_of(first: np.ndarray, second: np.ndarray) -> tuple[int, int]:
    """A set's two fingerprints: its n-grams' mixed sums, mixed with their number."""
    size = np.uint64(len(first))
    one = mix((mix(first).sum(dtype=np.uint64) ^ size)[None])
    two = mix_other((mix_other(second).sum(dtype=np.uint64) ^ size)[None])
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def _parts(ngrams: np.ndarray) -> np.ndarray:
    """How many n-grams fall into each part of their space, 32 parts or more; 255 stands for 255 and more."""
    bits = min(16, max(5, len(ngrams).bit_length() - 3))
    counts = np.bincount((ngrams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8)


def _overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """The largest intersection that two documents' parts allow; parts of the finer one are summed to the other's."""
    if len(a) > len(b):
        a, b = b, a
    if (b == 255).any() or (a == 255).any():
        a, b = (np.where(x == 255, 1 << 40, x.astype(np.int64)) for x in (a, b))
    else:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return int(np.minimum(a, b.reshape(len(a), -1).sum(axis=1)).sum())


def _least_overlap(a, b, num: int, den: int):
    """The smallest intersection with den * i >= num * (a + b - i)."""
    return -((-num * (a + b)) // (num + den))


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n, class (high and low, null for an empty set), parts and the text's hash (key) of every row; rows with a chunk hold a part of the sketch instead."""
    kind = documents.schema["doc_id"].dataType
    names = ["doc_id", "n", "high", "low", "parts", "chunk", "key"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_memory()
        sketch, seen, ids_type = np.zeros((1 << SKETCH_BITS) + (1 << WORD_BITS), np.int64), set(), None
        shift = np.uint64(64 - SKETCH_BITS)

        def see(words: np.ndarray) -> None:
            sketch[1 << SKETCH_BITS :] += np.bincount((words >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=1 << WORD_BITS)

        for batch in batches:
            n, high, low, parts = [], [], [], []
            ids_type = batch.column(0).type
            for first, second in shingle_sets(batch.column(1), k, see):
                n.append(len(first))
                if not len(first):
                    for column in (high, low, parts):
                        column.append(None)
                    continue
                key = _class_of(first, second)
                high.append(key[0])
                low.append(key[1])
                parts.append(_parts(first).tobytes())
                if key not in seen:
                    if len(seen) < HELD:
                        seen.add(key)
                    np.add.at(sketch, (first >> shift).astype(np.int64), 1)
            m = len(n)
            columns = [pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.nulls(m, pa.int32()), batch.column(2)], names=names)
        if sketch.any():
            chunks = np.minimum(sketch, 0xFFFFFFFF).astype("<u4").reshape(-1, _CHUNK)
            m = len(chunks)
            none = pa.nulls(m, pa.int64())
            bodies = pa.array([c.tobytes() for c in chunks], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(m, ids_type), none, none, none, bodies, pa.array(range(m), pa.int32()), none], names=names)
        del sketch, seen
        release_memory()

    schema = f"doc_id {kind.simpleString()}, n long, high long, low long, parts binary, chunk int, key long"
    return materialize(documents.select("doc_id", "text", F.xxhash64("text")).mapInArrow(sign, schema))


def rarity(signed: DataFrame) -> np.ndarray:
    """The sketches over all tasks as one byte for each counter, by eighths of a power of two: the n-grams' above their median, the words' as they are."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(chunk, np.zeros(_CHUNK, np.int64))
                held[chunk] += np.frombuffer(counts, "<u4")
        rank = [np.minimum(8 * np.log2(c + 1.0), 255).astype(np.uint8).tobytes() for c in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(rank, pa.binary())], names=["chunk", "rank"])

    parts = signed.where("chunk is not null").select("chunk", "parts").repartition(16, "chunk").mapInArrow(total, "chunk int, rank binary")
    out = np.zeros((1 << SKETCH_BITS) + (1 << WORD_BITS), np.uint8).reshape(-1, _CHUNK)
    for row in parts.collect():
        out[row["chunk"]] = np.frombuffer(row["rank"], np.uint8)
    out = out.reshape(-1)
    ngrams = out[: 1 << SKETCH_BITS]
    usual = np.median(ngrams[ngrams > 0]) if ngrams.any() else 0
    out[: 1 << SKETCH_BITS] = np.maximum(ngrams.astype(np.int64) - int(usual), 0)
    return out


def _entry_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int8()]
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["deal", "h", "high", "low", "n", "at", "crowd"])


def _spread(held: list[tuple[np.ndarray, tuple[int, int], int]]) -> pa.RecordBatch:
    """The entries of (prefix, class, size) rows: dealt by n-gram, those of a crowd by n-gram and class, with a marker (crowd 2) at the n-gram."""
    lengths = [len(x[0]) for x in held]
    h = np.concatenate([x[0] for x in held])
    high, low, n = (np.repeat(np.array(v, np.int64), lengths) for v in ([x[1][0] for x in held], [x[1][1] for x in held], [x[2] for x in held]))
    at = np.concatenate([np.arange(m, dtype=np.int32) for m in lengths])
    order = np.argsort(h, kind="stable")
    h, high, low, n, at = h[order], high[order], low[order], n[order], at[order]
    lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(lead, len(h)))
    crowd = np.repeat(sizes > CROWD, sizes)
    deal = np.where(crowd, mix(h ^ low.view(np.uint64)), h)
    marks = h[lead[sizes > CROWD]]
    zero = np.zeros(len(marks), np.int64)
    columns = [(deal, marks), (h, marks), (high, zero), (low, zero), (n, zero), (at, zero.astype(np.int32)), (crowd.astype(np.int8), zero.astype(np.int8) + 2)]
    return _entry_batch([np.concatenate(c) for c in columns])


def _shared(columns: list[np.ndarray], done: np.ndarray, num: int, den: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted entries go on: at a crowd's n-gram one of each class (not yet passed on), at others those that fit with another class there.

    And which rows must be seen again with what follows: none if nothing does.
    """
    deal, h, high, low, n, at, crowd = columns
    new = np.concatenate([[True], (deal[1:] != deal[:-1]) | (h[1:] != h[:-1])])
    other = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (crowd[1:] // 2 != crowd[:-1] // 2)]) | new
    lead = np.flatnonzero(new)
    many = np.add.reduceat(other.astype(np.int64), lead) > CROWD
    many |= np.maximum.reduceat(crowd, lead) > 0
    many |= np.logical_or.reduceat(done, lead)
    crowded = np.repeat(many, np.diff(np.append(lead, len(h))))
    out = crowded & other & (crowd < 2) & ~done
    few = np.flatnonzero(other & ~crowded)
    group = np.cumsum(new)[few]
    for step in range(1, CROWD):
        one = np.flatnonzero(group[step:] == group[:-step])
        if not len(one):
            break
        x, y = few[one], few[one + step]
        fit = np.minimum(n[x] - at[x], n[y] - at[y]) * (num + den) >= (n[x] + n[y]) * num
        out[x[fit]] = out[y[fit]] = True
    if last:
        return out, np.zeros(0, np.int64)
    if many[-1]:
        return out, np.array([len(h) - 1])
    out[lead[-1] :] = False
    return out, lead[-1] + np.flatnonzero(other[lead[-1] :])


def prefixes(documents: DataFrame, order: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(h, high, low, n, at): the prefix entries of classes at n-grams that several classes have in their prefixes and that may link some.

    order: ranks of the n-grams' counters and, if they are there, behind them those of the words'.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(order)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_memory()
        rank, shift = ranks.value[: 1 << SKETCH_BITS], np.uint64(64 - SKETCH_BITS)
        of_words = ranks.value[1 << SKETCH_BITS :]

        def weight(words: np.ndarray) -> np.ndarray:
            return of_words[(words >> np.uint64(64 - WORD_BITS)).astype(np.int64)].astype(np.int64) if len(of_words) else np.zeros(len(words), np.int64)

        held: list[tuple[np.ndarray, tuple[int, int], int]] = []
        seen: set[tuple[int, int]] = set()
        count = 0
        for batch in batches:
            for first, second, common in weighed_sets(batch.column(0), k, weight):
                n = len(first)
                if not n:
                    continue
                cls = _class_of(first, second)
                if cls in seen:
                    continue
                if len(seen) < HELD:
                    seen.add(cls)
                probe = n + num * n // -den + 1
                common = np.minimum(common, 0xFFFF).astype(np.uint64) << np.uint64(40)
                key = (rank[(first >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | common | (first >> np.uint64(24))
                held.append((first[np.argsort(key, kind="stable")[:probe]], cls, n))
                count += probe
                if count >= HELD:
                    yield _spread(held)
                    held, count = [], 0
        if held:
            yield _spread(held)
        del held, seen
        release_memory()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        passed = np.zeros(0, bool)
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            done = np.concatenate([passed, np.zeros(len(now[0]), bool)])
            if kept:
                now = [np.concatenate(both) for both in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            out, again = _shared(now, done, num, den, False)
            yield _entry_batch([c[out] for c in now])
            kept = [c[again] for c in now]
            # One row of a crowd that was passed on is enough to know it by; of a few classes all must be seen.
            passed = (out | done)[again] | (now[6][again] == 2)
        if kept:
            yield _entry_batch([c[_shared(kept, passed, num, den, True)[0]] for c in kept])
        release_memory()

    found = documents.select("text").mapInArrow(entries, _ENTRY)
    dealt = found.repartition(partitions(spark), "deal").sortWithinPartitions("deal", "h", F.col("crowd").desc(), "high", "low")
    return dealt.mapInArrow(meet, _ENTRY).select("h", "high", "low", "n", "at")


def _fits(num: int, den: int) -> Column:
    """Whether the sets of (n_a, at_a) and (n_b, at_b) can overlap enough if this is their first n-gram in common."""
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return room * (num + den) >= (F.col("n_a") + F.col("n_b")) * num


def led(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the entries of each n-gram against the two with the least and the greatest hash of their class."""
    own = F.struct(F.xxhash64("class").alias("hash"), "class", "n", "at")
    leaders = entries.groupBy("h").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low != high")
    leaders = leaders.select("h", F.explode(F.array("low", "high")).alias("lead"))
    met = entries.select("h", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b")).join(leaders, "h")
    met = met.select("b", "n_b", "at_b", F.col("lead.class").alias("a"), F.col("lead.n").alias("n_a"), F.col("lead.at").alias("at_a"))
    met = met.where(_fits(num, den) & (F.col("a") != F.col("b")))
    # A pair may meet from both sides; one leader remains its `a`.
    once = met.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("a").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("b"))


def fitting(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose parts leave room for a link."""
    for side in ("a", "b"):
        own = classes.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("parts").alias(f"parts_{side}"))
        pairs = pairs.join(own, side)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = _least_overlap(batch.column(2).to_numpy(), batch.column(3).to_numpy(), num, den)
            ok = [
                _overlap_bound(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) >= least
                for x, y, least in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), need, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "parts_a", "parts_b").mapInArrow(fit, "a long, b long")


def _sets(documents: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class, ngrams): the n-grams of the wanted classes by the second fingerprint, from one text of each."""
    wanted = classes.join(wanted, "class", "left_semi").select("class", "high", "low", F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    count = wanted.count()
    texts = documents.select("doc_id", "text").withColumn("_text", F.xxhash64("text"))
    same = (F.col("_text") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    got = texts.join(broadcast_if_small(wanted, count, SMALL), same).select("class", "high", "low", "text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_memory()
        seen: set[int] = set()
        for batch in batches:
            names, bodies, size = [], [], 0
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), shingle_sets(batch.column(3), k), strict=True)
            for name, high, low, (first, second) in rows:
                if name in seen or not len(first) or _class_of(first, second) != (high, low):
                    continue
                if len(seen) < HELD:
                    seen.add(name)
                names.append(name)
                bodies.append(second.tobytes())
                size += second.nbytes
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], names=["class", "ngrams"])
                    names, bodies, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], names=["class", "ngrams"])
        release_memory()

    return got.mapInArrow(fetch, "class long, ngrams binary")


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of the sorted sets shares with one."""
    out = np.zeros(len(others), np.int64)
    a = 0
    while a < len(others):
        b, size = a, 0
        while b < len(others) and (b == a or size + len(others[b]) <= _STEP):
            size += len(others[b])
            b += 1
        flat = np.concatenate(others[a:b])
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        owner = np.repeat(np.arange(a, b), [len(x) for x in others[a:b]])
        out[a:b] = np.bincount(owner[one[at] == flat] - a, minlength=b - a)
        a = b
    return out


def verified(documents: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The linked ones of distinct pairs (a, b): each is counted once, in a unit of an `a` and a bounded number of its `b`s."""
    spark = documents.sparkSession
    times = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / UNIT).alias("_units"))
    dealt = pairs.join(times, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("_units"))).alias("unit"))
    dealt = materialize(dealt)
    roles = dealt.select("unit", F.lit(0).cast("byte").alias("side"), F.col("a").alias("class")).distinct()
    roles = roles.unionByName(dealt.select("unit", F.lit(1).cast("byte").alias("side"), F.col("b").alias("class")))
    sets = _sets(documents, classes, roles.select("class").distinct(), k)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        leads: dict[int, np.ndarray] = {}
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            if held:
                sizes = np.array([len(x) for x in held.values()])
                for a, one in leads.items():
                    got = overlaps(one, list(held.values()))
                    linked = got >= _least_overlap(len(one), sizes, num, den)
                    found += [(a, b) for b, yes in zip(held, linked.tolist(), strict=True) if yes and a != b]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        size = 0
        for batch in batches:
            for unit, side, cls, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != now or size > 1 << 25:
                    yield out()
                    size = 0
                    if unit != now:
                        leads.clear()
                    now = unit
                (held if side else leads)[cls] = np.frombuffer(body, np.uint64)
                size += len(body)
        yield out()
        leads.clear()
        release_memory()

    rows = sets.join(roles, "class").select("unit", "side", "class", "ngrams")
    rows = rows.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "side")
    return materialize(rows.mapInArrow(check, "a long, b long"))


def paired(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the pairs of different components at each n-gram that fit, for n-grams with a bounded number of classes."""
    row = F.struct("class", "n", "at", "component")
    groups = entries.groupBy("h").agg(F.collect_set(row).alias("all"))
    both = groups.select("all", F.explode("all").alias("x"))

    def fits(y: Column) -> Column:
        other = (y["class"] > F.col("x.class")) & (y["component"] != F.col("x.component"))
        return other & (F.least(F.col("x.n") - F.col("x.at"), y["n"] - y["at"]) * (num + den) >= (F.col("x.n") + y["n"]) * num)

    both = both.select("x", F.explode(F.filter("all", fits)).alias("y"))
    return both.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def chained(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the classes at each n-gram tied together by a leader of their length band, and leaders of neighbouring bands."""
    width = max(math.log(den / num), 1e-9) * (1 + 1e-6)
    band = F.floor(F.log(F.col("n")) / F.lit(width))
    rows = entries.select("h", "class", band.alias("band"))
    leaders = materialize(rows.groupBy("h", "band").agg(F.min("class").alias("lead")))
    small = broadcast_if_small(leaders, leaders.count(), SMALL)
    members = rows.join(small, ["h", "band"]).where("class != lead").select(F.col("class").alias("a"), F.col("lead").alias("b"))
    following = leaders.select("h", (F.col("band") - 1).alias("band"), F.col("lead").alias("b"))
    return members.unionByName(leaders.join(following, ["h", "band"]).where("lead != b").select(F.col("lead").alias("a"), "b")).distinct()


def verify(sets: list[np.ndarray], side: np.ndarray, num: int, den: int, known: list[int] | None = None, every: bool = False) -> Iterator[tuple[int, int]]:
    """Linked pairs (i, j) of one unit: a forest of them that ties their components, or all of them.

    side: 0 and 1 for a pair of blocks (pairs go across), all 0 for a block with itself.
    known: a component of each set; pairs within one aren't looked at.
    """
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    unique, back, times = np.unique(flat, return_inverse=True, return_counts=True)
    posting = owner[np.argsort(back, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(times)])
    bits = min(12, max(5, int(n.min()).bit_length() - 3))
    parts = np.zeros((len(sets), 1 << bits), np.int32)
    np.add.at(parts, (owner, (flat >> np.uint64(64 - bits)).astype(np.int64)), 1)
    at = np.concatenate([[0], np.cumsum(n)])
    label = np.unique(np.arange(len(sets)) if known is None else np.array(known), return_inverse=True)[1]
    both = bool(side.any())
    for i in range(len(sets)):
        if both and side[i]:
            continue
        others = np.flatnonzero(side == 1) if both else np.arange(i + 1, len(sets))
        if not every:
            others = others[label[others] != label[i]]
        need = _least_overlap(n[i], n[others], num, den)
        fits = np.minimum(n[i], n[others]) >= need
        others, need = others[fits], need[fits]
        if len(others):
            fits = np.minimum(parts[i], parts[others]).sum(axis=1) >= need
            others, need = others[fits], need[fits]
        if not len(others):
            continue
        mine = back[at[i] : at[i + 1]]
        mine = mine[times[mine] > 1]
        counted = np.zeros(len(sets), np.int64)
        sums = np.cumsum(times[mine])
        a = 0
        while a < len(mine):
            before = int(sums[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(sums, before + _STEP, "right")))
            lengths = times[mine[a:b]]
            ends = np.cumsum(lengths)
            where = np.repeat(starts[mine[a:b]] - (ends - lengths), lengths) + np.arange(int(ends[-1]))
            counted += np.bincount(posting[where], minlength=len(sets))
            a = b
        for j in others[counted[others] >= need].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
            elif not every:
                continue
            yield i, j


def crowded(documents: DataFrame, classes: DataFrame, entries: DataFrame, edges: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the components at n-grams of many classes, a forest of them: blocks of what edges (a, b) tie together, by length."""
    spark = documents.sparkSession
    clusters = components(edges)
    own = entries.select("class", "n", F.col("component").alias("known")).distinct()
    members = own.join(clusters, own["class"] == clusters["node"]).select("class", "n", "known", F.col("component").alias("cluster"))
    numbered, _ = row_numbers(members, [F.col("cluster"), F.col("n"), F.col("class")], "_number")
    grade = F.floor(F.log2(F.col("n"))).cast("int")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_DOCS), F.floor(F.lit(float(BLOCK_NGRAMS)) / F.pow(F.lit(2.0), F.col("_grade") + 1)))).cast("long")
    placed = numbered.withColumn("_grade", grade).withColumn("block", F.struct("_grade", F.floor(F.col("_number") / room).cast("long").alias("at")))
    placed = materialize(placed.select("class", "n", "known", "cluster", "block"))
    blocks = placed.groupBy("cluster", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("known").alias("one"), F.max("known").alias("another")
    )
    blocks = materialize(blocks)
    x, y = blocks.alias("x"), blocks.alias("y")
    close = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block"))
    close &= F.least("x.high", "y.high") * den >= F.greatest("x.low", "y.low") * num
    # Blocks of one component alone have nothing to look for in themselves or in each other.
    close &= F.least("x.one", "y.one") < F.greatest("x.another", "y.another")
    pairs = x.join(y, close).select(F.col("x.cluster").alias("cluster"), F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    unit = F.xxhash64("cluster", "p", "q")
    left = pairs.select("cluster", F.col("p").alias("block"), unit.alias("unit"), F.lit(0).cast("byte").alias("side"))
    right = pairs.where("p != q").select("cluster", F.col("q").alias("block"), unit.alias("unit"), F.lit(1).cast("byte").alias("side"))
    roles = placed.join(left.unionByName(right), ["cluster", "block"]).select("class", "known", "unit", "side")
    sets = _sets(documents, classes, placed.select("class"), k)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        now: int | None = None

        def out() -> pa.RecordBatch:
            names = list(held)
            sides, sets_, known = np.array([s for _, s in names]), [v[0] for v in held.values()], [v[1] for v in held.values()]
            found = list(verify(sets_, sides, num, den, known)) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[p[i]][0] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for u, s, cls, known, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != now:
                    yield out()
                    held.clear()
                    now = u
                held[cls, s] = (np.frombuffer(body, np.uint64), known)
        yield out()
        held.clear()
        release_memory()

    rows = sets.join(roles, "class").select("unit", "side", "class", "known", "ngrams")
    rows = rows.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "side", "class")
    return materialize(rows.mapInArrow(check, "a long, b long"))


def links(documents: DataFrame, classes: DataFrame, order: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b) between classes, enough of them to tie every component together."""
    named = classes.select(F.col("high").alias("_high"), F.col("low").alias("_low"), "class")
    found = prefixes(documents, order, k, num, den)
    entries = found.join(named, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low"))).select("h", "class", "n", "at")
    entries = materialize(entries)
    first = materialize(fitting(led(entries, num, den), classes, num, den))
    found = verified(documents, classes, first, k, num, den)
    known = components(found).select(F.col("node").alias("class"), "component")
    labelled = entries.join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
    many = labelled.groupBy("h").agg(F.min("component").alias("_one"), F.max("component").alias("_other"), F.count(F.lit(1)).alias("_count"))
    many = many.where("_one != _other AND _count > 3").select("h", "_count")
    left = materialize(labelled.join(many, "h"))
    again = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def listed(some: Column) -> DataFrame:
        return fitting(paired(left.where(some), num, den).join(again, ["a", "b"], "left_anti"), classes, num, den)

    few = materialize(listed(F.col("_count") <= CROWD))
    if not few.isEmpty():
        found = found.unionByName(verified(documents, classes, few, k, num, den))
    crowds = left.where(F.col("_count") > CROWD)
    if crowds.isEmpty():
        return found
    edges = listed(F.col("_count").between(CROWD + 1, PAIRED)).unionByName(chained(left.where(F.col("_count") > max(CROWD, PAIRED)), num, den))
    return found.unionByName(crowded(documents, classes, crowds, edges, k, num, den))


def ngram_components(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id (the smallest doc_id its links reach, itself included).

    Words are runs of anything but ASCII white space, A-Z lower-cased. A document
    with fewer than k words has one shingle, its whole word sequence; without
    words (or text) it has none, links with nothing and is its own component. Two
    documents link if den * |intersection| >= num * |union|. Rows with one doc_id
    are rows of their own but share its number; a null doc_id is never the
    smallest unless its component has no other. Extra columns are ignored.
    """
    return _grouped(documents, k, num, den).select("doc_id", "n_shingles", "component_id")


def _grouped(documents: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The rows of ngram_components, each with its component's own number (group, null without words) and its text's hash (key)."""
    signed = signatures(documents, k)
    rows = signed.where("chunk is null")
    full = rows.where("high is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = full.groupBy("high", "low").agg(first, F.min("n").alias("n"), F.any_value("parts").alias("parts"))
    classes = materialize(classes.select("high", "low", "first.doc_id", "first.key", "n", "parts", F.monotonically_increasing_id().alias("class")))
    linked = components(links(documents, classes, rarity(signed), k, num, den))
    classes = classes.select("high", "low", "class", F.col("doc_id").alias("least"))
    joined = classes.join(linked, classes["class"] == linked["node"], "left").select("high", "low", "class", "least", "component")
    least = joined.where("component is not null").groupBy("component").agg(F.min("least").alias("of_all"))
    named = joined.join(least, "component", "left")
    named = named.select("high", "low", F.coalesce("of_all", "least").alias("component_id"), F.coalesce("component", "class").alias("group"))
    out = full.join(named, ["high", "low"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "group", "key")
    none = rows.where("high is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"), "key")
    return out.unionByName(none)


def without_near_copies(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents without near copies: of each group of linked ones the row with the smallest doc_id stays.

    Documents without words stay. Rows without a doc_id stay only if their group has
    no other; of rows with one doc_id and text one stays. Rows of one group that share
    a doc_id but not a text are near copies too: the one with the least hash stays.
    """
    groups = materialize(_grouped(documents, k, num, den).select("doc_id", "group", "key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("_first")
    kept = groups.where("group is not null").groupBy("group").agg(first).select("_first.doc_id", "_first.key")
    kept = kept.unionByName(groups.where("group is null").select("doc_id", "key").distinct())
    kept = kept.select(F.col("doc_id").alias("_kept"), F.col("key").alias("_key"))
    total, ids = groups.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).first()
    same = F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_text") == F.col("_key"))
    out = documents.withColumn("_text", F.xxhash64("text")).join(broadcast_if_small(kept, total, SMALL), same, "left_semi")
    if ids < total:
        out = out.dropDuplicates(["doc_id", "_text"])
    return out.drop("_text")
