"""Exact top-k by inner product with M-trees.

Rows are ordered by their nearest of some pivots, near pivots next to each other, and cut
into blocks of bounded size, the leaves of a tree. A block is a table row that holds its vectors, their centre and
covering radius. Nodes in a row are children of a page, which keeps their centres, radii
and distances to its own centre, up to one root for each length of vectors. Queries
descend level by level in packets of bounded size: from a page a packet goes on only to
children whose ball can hold a row as good as the query's bound, the k-th best of a
bounded sample, and a child's product is computed only if its stored distance and radius
leave that open. So no query meets a block that its bound excludes, and no level is held
by one task.

A block is an M-tree of two levels. With M the largest norm in it, a vector v gets the
further coordinate sqrt(M * M - |v| * |v|), a query a 0; then |q - v|^2 = |q|^2 + M^2 -
2 q.v is a metric's square, and the largest products are the nearest neighbours. A
page of the block keeps its routing vector, covering radius and distance to the block's
first, a row its distance to its page's. A search visits pages best first, skips pages
whose distance to the query needn't be computed, ends when no page can hold a better
row, and within a page computes only products that the stored distances leave open.
Products are computed in integers; the distances only prune, with a margin for rounding.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_tools import materialize, partitions, row_numbers

#: Rows in a block, routing vectors in it, children of a node, queries in a packet, packets for a block in one unit of work.
BLOCK, PAGE, FAN, PACKET, PACKETS = 2048, 64, 256, 512, 64
#: Bytes of queries in a packet (one query at least), and of packets that a task passes on at once.
PACKET_BYTES, HELD_BYTES = 1 << 16, 1 << 22
#: Queries of so many bytes at most are broadcast; packets at blocks then name them only.
SHARED_BYTES = 1 << 26
#: A packet meets many blocks. A dictionary would write its bytes once, and reading a batch of rows would unfold them all.
_LARGE_ROWS = {"parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 23)}
#: Rows in the sample that gives pivots and first bounds, and pivots.
SAMPLE, PIVOTS = 2048, 1024
_EXACT = float(1 << 20)
_LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: str = "embedding") -> Column:
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~odd, F.lit(False))


def quantized(vector: str = "embedding") -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * 256).cast("double"))


class Best:
    """The best (score, id) rows that hold the k best of any but one id: up to the (k + 1)th id, of each id k rows."""

    def __init__(self, k: int):
        self.k, self.rows, self.full = k, [], False

    def add(self, score: float, number: int) -> None:
        entry = (-score, number)
        if self.full and entry >= self.rows[-1]:
            return
        bisect.insort(self.rows, entry)
        times: Counter = Counter()
        kept = []
        for row in self.rows:
            times[row[1]] += 1
            if times[row[1]] <= self.k:
                kept.append(row)
            if len(times) > self.k:
                break
        self.rows, self.full = kept, len(times) > self.k

    def least(self) -> float:
        """A score that any further row must reach."""
        return -self.rows[-1][0] if self.full else -math.inf


class Tree:
    """An M-tree of two levels over integer vectors (as float64, exact below 2 ** 53): a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        norm2 = np.einsum("ij,ij->i", self.x, self.x)
        self.top2 = float(norm2.max())
        lift = np.sqrt(np.maximum(self.top2 - norm2, 0))
        n = len(self.x)
        self.margin = 1e-6 * (self.top2 + 1)
        step = max(1, n // max(1, n // PAGE))
        routing = np.arange(0, n, step)

        def apart(a: np.ndarray) -> np.ndarray:
            d2 = norm2[:, None] + norm2[a][None, :] - 2 * self.x @ self.x[a].T + (lift[:, None] - lift[a][None, :]) ** 2
            return np.sqrt(np.maximum(d2, 0))

        distance = apart(routing)
        page = distance.argmin(axis=1)
        used = np.unique(page)
        self.rows = [np.flatnonzero(page == p) for p in used]
        self.own = [distance[r, p] for r, p in zip(self.rows, used, strict=True)]
        self.radius = np.array([d.max() for d in self.own])
        self.route, self.route_lift = self.x[routing[used]], lift[routing[used]]
        self.to_root = distance[routing[used], used[0]]

    def search(self, q: np.ndarray, k: int, bound: float) -> Best:
        """The best rows of those with a score of `bound` at least."""
        q2 = float(q @ q)
        base = q2 + self.top2

        def nearest(score: float) -> float:
            return math.sqrt(max(base - 2 * score, 0) + self.margin) if score > -math.inf else math.inf

        best = Best(k)
        limit = nearest(bound)
        root = math.sqrt(max(base - 2 * float(q @ self.route[0]), 0))
        open_pages = np.flatnonzero(np.abs(root - self.to_root) - self.radius <= limit)
        if not len(open_pages):
            return best
        d = np.sqrt(np.maximum(base - 2 * (self.route[open_pages] @ q), 0))
        least = np.maximum(d - self.radius[open_pages], 0)
        queue = [(float(v), int(p), float(x)) for v, p, x in zip(least, open_pages, d, strict=True) if v <= limit]
        heapq.heapify(queue)
        while queue:
            v, p, x = heapq.heappop(queue)
            if v > limit:
                break
            rows = self.rows[p][np.abs(x - self.own[p]) <= limit]
            if not len(rows):
                continue
            scores = self.x[rows] @ q
            for r in np.flatnonzero(scores >= bound):
                best.add(float(scores[r]), int(self.ids[rows[r]]))
            if best.least() > bound:
                bound = best.least()
                limit = nearest(bound)
        return best


class Ball:
    """The children of a page: centres, covering radii and distances to the page's own centre."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray):
        self.centres, self.radii = centres, radii
        self.centre = centres.mean(axis=0)
        self.apart = np.linalg.norm(centres - self.centre, axis=1)
        self.radius = float((self.apart + radii).max())

    @staticmethod
    def open(centre: np.ndarray, centres: np.ndarray, radii: np.ndarray, apart: np.ndarray, q: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """[query, child]: whether a child can hold a row whose product with a query reaches its bound."""
        length = np.linalg.norm(q, axis=1)[:, None]
        slack = 1e-6 * (1 + length * (np.linalg.norm(centre) + float((apart + radii).max())))
        far = (q @ centre)[:, None] + length * (apart + radii)[None, :] + slack
        out = far >= bounds[:, None]
        asked = out.any(axis=0)
        out[:, asked] &= q @ centres[asked].T + length * radii[asked][None, :] + slack >= bounds[:, None]
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one: blocks and packets are large, and a batch of them in Python objects is several times its size."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _matrix(bodies: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in bodies])


def _by_number(queries: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the numbers of its queries (query, size, body), sorted, and their vectors."""
    numbers, sizes, bodies = queries["query"].to_numpy(), queries["size"].to_numpy(), queries["body"].to_pylist()
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        at = at[np.argsort(numbers[at])]
        out[size] = numbers[at], _matrix([bodies[i] for i in at.tolist()])
    return out


def _exact(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> Best:
    """The search in Python integers, for components too large for exact float64 products; scores stop at a long's ends."""
    whole, best = [int(v) for v in q], Best(k)
    for i, row in zip(ids, x, strict=True):
        best.add(min(max(sum(a * int(b) for a, b in zip(whole, row, strict=True)), _LONG[0]), _LONG[1]), int(i))
    return best


def _kept(rows: DataFrame, k: int) -> DataFrame:
    """Rows (vec_id, x) without those of equal vectors that can't be among the k best of any query: k + 1 ids, of each k rows."""
    keyed = rows.withColumn("_key", F.xxhash64("x", F.size("x")))
    same = Window.partitionBy("_key", "x", "vec_id").orderBy("vec_id")
    keyed = keyed.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k)
    equal = Window.partitionBy("_key", "x").orderBy("vec_id")
    return keyed.withColumn("_n", F.dense_rank().over(equal)).where(F.col("_n") <= k + 1).select("vec_id", "x")


def _chain(x: np.ndarray) -> np.ndarray:
    """The vectors in an order in which each is followed by the nearest of the rest."""
    left, order = np.ones(len(x), bool), [0]
    for _ in range(len(x) - 1):
        left[order[-1]] = False
        rest = np.flatnonzero(left)
        order.append(int(rest[((x[rest] - x[order[-1]]) ** 2).sum(axis=1).argmin()]))
    return x[order]


def _leaves(packed: DataFrame, sample: dict[int, np.ndarray]) -> DataFrame:
    """Blocks (node, size, ids, body, centre, radius) of packed rows that are near each other."""
    spark = packed.sparkSession
    pivots = spark.sparkContext.broadcast({size: _chain(x[:PIVOTS]) for size, x in sample.items()})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            bodies = np.array(batch.column(2).to_pylist(), dtype=object)
            pivot, distance = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                if size not in pivots.value:
                    continue
                p, at = pivots.value[size], np.flatnonzero(sizes == size)
                for a in range(0, len(at), 4096):
                    part = at[a : a + 4096]
                    x = _matrix(bodies[part].tolist())
                    d2 = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T
                    pivot[part] = d2.argmin(axis=1)
                    distance[part] = np.sqrt(np.maximum(d2.min(axis=1), 0))
            names = ["vec_id", "size", "body", "pivot", "distance"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(distance)], names=names)

    order = [F.col("size"), F.col("pivot"), F.col("distance"), F.col("vec_id")]
    placed = materialize(packed.mapInArrow(nearest, "vec_id long, size int, body binary, pivot int, distance double"))
    dealt = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("vec_id", "size", "body")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, now, ids, bodies = TaskContext.get().partitionId() << 33, None, [], []

        def block() -> pa.RecordBatch:
            x = _matrix(bodies)
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
            columns = [
                pa.array([number], pa.int64()),
                pa.array([now], pa.int32()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([b"".join(bodies)], pa.binary()),
                pa.array([centre.tobytes()], pa.binary()),
                pa.array([radius], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["node", "size", "ids", "body", "centre", "radius"])

        for batch in batches:
            for vec_id, size, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (size != now or len(ids) == BLOCK):
                    yield block()
                    number, ids, bodies = number + 1, [], []
                now = size
                ids.append(vec_id)
                bodies.append(body)
        if ids:
            yield block()

    return materialize(dealt.mapInArrow(cut, "node long, size int, ids array<long>, body binary, centre binary, radius double"))


def _above(nodes: DataFrame) -> DataFrame:
    """Pages (node, size, centre, radius, children, centres, radii, apart) over nodes, FAN at most in each."""
    numbered, _ = row_numbers(nodes.select("node", "size", "centre", "radius"), [F.col("size"), F.col("node")], "_at")
    first = numbered.groupBy("size").agg(F.min("_at").alias("_first"))
    numbered = numbered.join(first, "size").withColumn("_page", F.floor((F.col("_at") - F.col("_first")) / FAN))
    grouped = numbered.groupBy("size", "_page").agg(F.array_sort(F.collect_list(F.struct("node", "centre", "radius"))).alias("all"), F.min("_at").alias("page"))

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "size", "centre", "radius", "children", "centres", "radii", "apart"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for size, node, children in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ball = Ball(_matrix([c["centre"] for c in children]), np.array([c["radius"] for c in children]))
                row = (node, size, ball.centre.tobytes(), ball.radius, [c["node"] for c in children], ball.centres.tobytes(), ball.radii.tobytes(), ball.apart.tobytes())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=names)

    schema = "node long, size int, centre binary, radius double, children array<long>, centres binary, radii binary, apart binary"
    return materialize(grouped.select("size", "page", "all").mapInArrow(page, schema))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The levels of pages over the leaves, the root's first: one root for each length of vectors."""
    levels = [_above(leaves)]
    while levels[0].groupBy("size").count().where("count > 1").limit(1).count():
        levels.insert(0, _above(levels[0]))
    return levels


def descended(queries: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(node, queries, bounds, body): packets of queries at the leaves that their bounds leave open.

    queries: (query, size, body, bound).
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def packet(size: int) -> pa.RecordBatch:
            numbers, bounds, bodies = zip(*held.pop(size), strict=True)
            columns = [pa.array([size], pa.int32()), pa.array([numbers], pa.list_(pa.int64())), pa.array([bounds], pa.list_(pa.float64())), pa.array([b"".join(bodies)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["size", "queries", "bounds", "body"])

        for batch in batches:
            for number, size, body, bound in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(size, []).append((number, bound, body))
                if len(held[size]) >= min(PACKET, max(1, PACKET_BYTES // (8 * size))):
                    yield packet(size)
        for size in list(held):
            yield packet(size)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]
        names = ["node", "size", "queries", "bounds", "body"]
        out: list[tuple] = []
        held = 0

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for size, queries_, bounds_, body, centre, children, *shape in _rows(batches):
            q, bounds, numbers = np.frombuffer(body, np.float64).reshape(-1, size), np.array(bounds_), np.array(queries_, np.int64)
            centres, radii, apart = (np.frombuffer(x, np.float64) for x in shape)
            open_ = Ball.open(np.frombuffer(centre, np.float64), centres.reshape(-1, size), radii, apart, q, bounds)
            for c in np.flatnonzero(open_.any(axis=0)).tolist():
                i = np.flatnonzero(open_[:, c])
                out.append((children[c], size, numbers[i], bounds[i], q[i].tobytes()))
                held += 8 * (size + 2) * len(i)
                if held >= HELD_BYTES:
                    yield passed()
                    out.clear()
                    held = 0
        if out:
            yield passed()

    packets = queries.select("query", "size", "body", "bound").mapInArrow(gather, "size int, queries array<long>, bounds array<double>, body binary")
    packets = packets.join(levels[0].select("size", "node"), "size")
    for pages in levels:
        met = packets.join(pages.drop("radius", "size"), "node").select("size", "queries", "bounds", "body", "centre", "children", "centres", "radii", "apart")
        packets = met.mapInArrow(down, "node long, size int, queries array<long>, bounds array<double>, body binary")
    return packets


def _asked(queries: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(query, size, body, bound): each query with a score that its k best rows reach, from rows of k + 1 ids."""
    shared = queries.sparkSession.sparkContext.broadcast(sample)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = []
            for size, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                q, x = np.frombuffer(body, np.float64), shared.value.get(size, np.zeros((0, size)))
                wide = np.abs(q).max() >= _EXACT or (len(x) and np.abs(x).max() >= _EXACT)
                bounds.append(-math.inf if wide or len(x) <= k else float(np.partition(x @ q, len(x) - k - 1)[len(x) - k - 1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.float64())], names=["query", "size", "body", "bound"])

    return queries.select("query", "size", "body").mapInArrow(bounded, "query long, size int, body binary, bound double")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest products, ties to the smaller vec_id.

    rows, queries: (vec_id, x), x integers as doubles, of any but equal length (rows of
    another length than a query's are no candidates for it). Rows of a query's own vec_id
    are no candidates. Rows that repeat a vec_id are rows of their own; equal queries are
    searched once. Rows with a null vec_id take no part. Fewer candidates give fewer rows.
    """
    spark = rows.sparkSession
    packed = materialize(_packed(_kept(rows.where("vec_id is not null").select("vec_id", "x"), k)))
    taken = packed.orderBy(F.xxhash64("vec_id"), "vec_id", "body").limit(SAMPLE).toArrow().to_pydict()
    by_id = {(len(body) // 8, vec_id): body for vec_id, body in zip(taken["vec_id"], taken["body"], strict=True)}
    sample = {size: _matrix([b for (s, _), b in by_id.items() if s == size]) for size in {s for s, _ in by_id}}
    leaves = _leaves(packed, sample)
    asked = queries.where("vec_id is not null").select("vec_id", "x").distinct()
    distinct = materialize(asked.select("x").distinct().withColumn("query", F.monotonically_increasing_id()))
    named = asked.join(distinct, "x").select(F.col("vec_id").alias("query_id"), "query")
    numbered = _packed(distinct.select(F.col("query").alias("vec_id"), "x")).withColumnRenamed("vec_id", "query")
    packets = descended(_asked(numbered, sample, k), tree(leaves))
    known = None
    if numbered.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0] <= SHARED_BYTES:
        known = spark.sparkContext.broadcast(_by_number(numbered.toArrow()))
        packets = packets.withColumn("body", F.lit(b""))
    packets = materialize(packets, **_LARGE_ROWS)
    many = packets.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / PACKETS).cast("int").alias("_units"))
    unit = F.pmod(F.xxhash64("queries"), F.col("_units")).cast("int")
    packets = packets.join(many, "node").select("node", unit.alias("unit"), "size", F.lit(1).alias("kind"), F.col("queries").alias("ids"), "bounds", "body")
    blocks = leaves.join(many, "node").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("_units") - 1)).alias("unit"), "size", F.lit(0).alias("kind"), "ids", F.array().cast("array<double>").alias("bounds"), "body"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, wide = None, False
        out: tuple[list, list, list] = ([], [], [])

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query", "vec_id", "score"])

        for _, _, size, kind, ids, bounds, body in _rows(batches):
            if kind and known is not None:
                numbers, every = known.value[size]
                x = every[np.searchsorted(numbers, ids)]
            else:
                x = np.frombuffer(body, np.float64).reshape(-1, size)
            if kind == 0:
                block, wide = Tree(np.array(ids, np.int64), x), bool(np.abs(x).max() >= _EXACT)
                continue
            for number, bound, q in zip(ids, bounds, x, strict=True):
                exact = wide or np.abs(q).max() >= _EXACT
                best = _exact(block.ids, block.x, q, k) if exact else block.search(q, k, bound)
                for score, vec_id in best.rows:
                    out[0].append(number)
                    out[1].append(vec_id)
                    out[2].append(int(-score))
            if len(out[0]) >= 1 << 14:
                yield found()
                for column in out:
                    column.clear()
        yield found()

    units = blocks.unionByName(packets).repartition(partitions(spark), "node", "unit").sortWithinPartitions("node", "unit", "kind")
    found = units.mapInArrow(search, "query long, vec_id long, score long")
    each = Window.partitionBy("query", "vec_id").orderBy(F.desc("score"))
    found = found.withColumn("_n", F.row_number().over(each)).where(F.col("_n") <= k)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k * (k + 1))
    out = named.join(found.select("query", "vec_id", "score"), "query").where(F.col("vec_id") != F.col("query_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _packed(rows: DataFrame) -> DataFrame:
    """(vec_id, size, body): vectors as the bytes of their float64 components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            lengths = x.value_lengths().to_numpy(zero_copy_only=False)
            flat = x.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lengths)])
            bodies = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths.astype(np.int32)), pa.array(bodies, pa.binary())], names=["vec_id", "size", "body"]
            )

    return rows.select("vec_id", "x").mapInArrow(pack, "vec_id long, size int, body binary")


def search_embeddings(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The registered search: queries are the rows whose vec_id is divisible by `every`, candidates all rows.

    Components become floor(256 * x). Vectors that are null, empty, or hold null or
    non-finite components take no part. Rows that repeat a vec_id are rows of their own;
    if they ask with several vectors, the best over all of them are ranked once for the id.
    Extra columns are ignored.
    """
    rows = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), quantized().alias("x"))
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
