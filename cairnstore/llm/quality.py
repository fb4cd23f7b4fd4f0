"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A document's features are the distinct byte n-grams of its text and the distinct
n-grams of its words' shapes (case, letters or digits or marks, what it ends
with, and whether it repeats the word before), hashed into a fixed number of
buckets. Indicators are scaled by the log-count ratio of the two classes, every
document's vector is brought to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent. Scores are the margins through a logistic
curve fitted on documents that the model wasn't.

Only the fit is bounded: it takes at most `sample` labelled documents, chosen by hash,
and of these, in that order, as many as have SAMPLE_BYTES of features together. Every
document is scored on its whole text; long texts are read in segments, whose n-grams
run across their ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import drop, materialize
from .wordhash import _SPACE, _segments, buffers, fingerprints, fresh_memory, mix, release_memory

BITS = 18
#: Labelled documents used for fitting, at most, and bytes of their features (four for each) that reach the driver, at most.
SAMPLE, SAMPLE_BYTES = 6000, 256 << 20
THRESHOLD = 0.3

_UPPER, _LOWER_, _DIGIT, _WIDE, _MARK = 1, 2, 4, 8, 16
_KIND = np.full(256, _MARK, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER_, _DIGIT, _WIDE


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt << 56)) >> np.uint64(64 - BITS)).astype(np.int32)


def _byte_grams(data: np.ndarray) -> list[np.ndarray]:
    """Distinct byte pairs and triples of a text, as buckets."""
    out = []
    wide = data.astype(np.uint32)
    for n in (2, 3):
        if len(data) < n:
            break
        code = wide[: len(data) - n + 1].copy()
        for j in range(1, n):
            code <<= np.uint32(8)
            code |= wide[j : len(data) - n + 1 + j]
        if n == 2:
            code = np.flatnonzero(np.bincount(code, minlength=1 << 16))
        else:
            code = np.unique(code)
        out.append(_bucket(code.astype(np.uint64), n))
    return out


def _shapes(data: np.ndarray) -> list[np.ndarray]:
    """Of each word of a segment: what kinds of characters it has, its first and last, its length's logarithm, and its fingerprints."""
    inside = ~_SPACE[data]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(begins):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    kinds = np.bitwise_or.reduceat(_KIND[data] * inside, begins).astype(np.int64)
    length = np.minimum(np.log2(ends - begins).astype(np.int64), 7)
    last = data[ends - 1]
    last = np.where(_KIND[last] == _MARK, last, 0).astype(np.int64)
    return [kinds, _KIND[data[begins]].astype(np.int64), last, length, *fingerprints(data, begins, ends)]


def _shape_grams(shapes: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct 1-, 2- and 3-grams of the word shapes of a text's segments, as buckets."""
    kinds, first, last, length, one, other = shapes[0] if len(shapes) == 1 else (np.concatenate(x) for x in zip(*shapes, strict=True))
    if not len(kinds):
        return []
    same = np.zeros(len(kinds), bool)
    same[1:] = (one[1:] == one[:-1]) & (other[1:] == other[:-1])
    shape = (((kinds << 5 | first) << 8 | last) << 3 | length) << 1 | same
    coarse = ((kinds << 8 | last) << 1 | same).astype(np.uint64)
    out = [_bucket(np.unique(shape).astype(np.uint64), 8)]
    rolled = coarse
    for n in (2, 3):
        if len(coarse) >= n:
            rolled = mix(rolled[: len(coarse) - n + 1] + coarse[n - 1 :] * np.uint64(n))
            out.append(_bucket(np.unique(rolled), 8 + n))
    return out


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct feature buckets of each text; a null or empty text has none."""
    data, bounds = buffers(column)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found: list[np.ndarray] = []
        shapes = []
        for start, stop in _segments(data[a:b], np.array([0, b - a])):
            found += _byte_grams(data[a + start : min(a + stop + 2, b)])
            shapes.append(_shapes(data[a + start : a + stop]))
        if shapes:
            found += _shape_grams(shapes)
        yield np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    """weight: of each bucket, scaled by the log-count ratio; ratio2: the squared ratios, for a document's length."""

    weight: np.ndarray
    ratio2: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        length = float(self.ratio2[x].sum()) ** 0.5
        return float(self.weight[x].sum()) / length + self.bias if length else self.bias

    def score(self, x: np.ndarray) -> float:
        z = self.slope * self.margin(x) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """L1-loss support vectors with a bias: one pass after another over the duals in random order."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = []
    for x in rows:
        v = scale[x]
        length = float(np.sqrt((v * v).sum()))
        values.append(v / length if length else v)
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance of label 1, by Newton's method on smoothed targets."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    plus, minus = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    x = np.stack([margins, np.ones(len(margins))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (t - p))
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 15, smooth: float = 1.0, seed: int = 0) -> Model:
    """The model of feature rows and 0/1 labels. Every fifth row is kept for the logistic curve.

    Without rows every score is 0.5; with one label only it is near that label.
    """
    size = 1 << BITS
    if not len(rows):
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, 0.0)
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    apart = np.arange(len(rows)) % 5 == 4
    train = [x for x, a in zip(rows, apart, strict=True) if not a]
    held = [x for x, a in zip(rows, apart, strict=True) if a]
    yt = y[~apart]
    counts = {s: np.zeros(size) + smooth for s in (1.0, -1.0)}
    for x, s in zip(train, yt, strict=True):
        counts[s][x] += 1
    plus, minus = ((counts[s] / counts[s].sum()) for s in (1.0, -1.0))
    ratio = np.log(plus / minus)
    w, bias = _dual_descent(train, ratio, yt, cost, rounds, seed)
    model = Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)
    if (y > 0).all() or (y < 0).all():
        model.weight[:] = 0
        model.bias, model.slope, model.offset = float(y[0]), 3.0, 0.0
        return model
    at = held if len(held) >= 20 else train
    model.slope, model.offset = _logistic(np.array([model.margin(x) for x in at]), y[apart] if at is held else yt)
    return model


def held_out(doc_id: str = "doc_id"):
    """True for rows whose id is kept from fitting: crc32 of its decimal text is divisible by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 0, most_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of at most `sample` labelled documents that aren't held out, chosen by a hash of their id.

    Of several labels of one document the smallest counts, of several rows the text with
    the least hash; rows with a null label or id are ignored. Features that would pass
    `most_bytes` together are left out, the last in order first.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.where(~held_out()).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    picked = picked.select(F.col("doc_id").alias("_id"), "quality")
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row.astype("<i4").tobytes() for row in features(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])

    got = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    kept = materialize(got.mapInArrow(extract, f"doc_id {kind}, quality int, x binary"))
    sizes = sorted(((zlib.crc32(str(r[0]).encode()), r[0], r[1]) for r in kept.select("doc_id", F.octet_length("x")).collect()))
    within = np.cumsum([r[2] for r in sizes]) <= most_bytes
    fits = kept if within.all() else kept.where(F.col("doc_id").isin([r[1] for r, ok in zip(sizes, within.tolist(), strict=True) if ok]))
    table = fits.toArrow()
    drop(kept)
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "x", "quality")), strict=True), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    return fit([np.frombuffer(r[1], "<i4") for r in rows], np.array([r[2] for r in rows]))


def scored(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """documents with the model's score (0 to 1) in a column of that name, which replaces one of documents."""
    documents = documents.drop(name)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_memory()
        m = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                scores = [m.score(x) for x in features(batch.column(at))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])
        release_memory()

    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(judge, f"{kept}, `{name}` double")


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of documents, with their own columns, whose score is `threshold` at least.

    Null and empty texts get the model's score for no features; rows that repeat a
    doc_id are judged each for itself; an empty table stays empty; extra columns are
    kept, whatever their names.
    """
    out = scored(documents, train(documents, labels, sample), "_accepted_score")
    return out.where(F.col("_accepted_score") >= threshold).drop("_accepted_score")


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every document.

    A null or empty text has no features and gets the model's score for that. Texts of
    any length are scored whole. Rows that repeat a doc_id are scored each for itself.
    Labels of unknown documents, and extra columns, are ignored; without usable labels
    every score is 0.5.
    """
    out = scored(documents.select("doc_id", "text"), train(documents, labels, sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
