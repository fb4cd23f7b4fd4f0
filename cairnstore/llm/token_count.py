"""Token counts from the pieces of distinct pre-tokens.

A pre-token is a stretch of text within which the model may merge and across
whose ends it can't: no piece of its vocabulary has a character of the one class
followed by one of the other (classes: blank, line feed, ASCII letter, digit,
punctuation, control, other). That table is read off the vocabulary. A text's
count is then the sum of its pre-tokens' counts, and no ids are made.

Each distinct pre-token is segmented once. Counts of the most frequent ones, a
fixed number, are broadcast; per-document frequencies of all others are joined
to the table of counts by two independent 64-bit fingerprints, so no key of that
join is hot and two pre-tokens that share one fingerprint keep counts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import materialize
from .wordhash import buffers, fingerprints, fresh_memory, mix, release_memory, slices

#: Pre-tokens whose counts are broadcast (20 bytes each).
HEAD = 1 << 18
#: Distinct pre-tokens held by a task before it passes them on.
HELD = 1 << 18
_BYTES = 1 << 20

_BLANK, _FEED, _LETTER, _DIGIT, _MARK, _CONTROL, _WIDE = range(7)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[:32] = _CLASS[127] = _CONTROL
_CLASS[0x20], _CLASS[0x0A] = _BLANK, _FEED
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[128:] = _WIDE


def cuts(model: bytes) -> np.ndarray:
    """Where a text may be cut: [class before, class after], from the model's vocabulary.

    A multi-byte character is one class throughout, and a character's own bytes are never parted.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    allowed = np.ones((7, 7), bool)
    for i in range(len(sp)):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        raw = np.frombuffer(sp.id_to_piece(i).replace("▁", " ").encode(), np.uint8)
        kinds = _CLASS[raw]
        allowed[kinds[:-1], kinds[1:]] = False
    allowed[_WIDE, _WIDE] = False
    return allowed


def pretokens(column: pa.Array, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both fingerprints, first byte, end and row of every pre-token of the column, and the bytes they point into.

    The model puts a blank before a text and takes U+2581 for a blank; both are done here. Empty texts have none.
    """
    column = pc.fill_null(column, "")
    column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise("", pc.replace_substring(column, "▁", " "), " "))
    data, bounds = buffers(column)
    kinds = _CLASS[data]
    start = np.ones(len(data), bool)
    start[1:] = allowed[kinds[:-1], kinds[1:]]
    start[bounds[:-1][bounds[:-1] < len(data)]] = True
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], len(data)) if len(begins) else begins
    h, other = fingerprints(data, begins, ends)
    return h, other, begins, ends, np.searchsorted(bounds, begins, "right") - 1, data


def distinct_of(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of fingerprints: where each is first, which each row has, and how often it occurs."""
    _, at, back, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if (other[at][back] != other).any():
        _, at, back, times = np.unique(np.stack([h, other], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    return at, back.reshape(-1), times


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of the most frequent pre-tokens, `most` at most: down to a frequency that a histogram of eighths of octaves gives."""
    grade = F.floor(8 * F.log2("times"))
    counts = sorted((tuple(r) for r in table.groupBy(grade).count().collect()), reverse=True)
    held, least = 0, None
    for g, n in counts:
        held += n
        if held > most:
            break
        least = g
    return table.where(grade >= least) if least is not None else table.limit(0)


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """Per row of documents: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Counts are the model's own without begin and end tokens; special strings in a
    text are text. A null or empty text has 0 bytes and 0 tokens. Rows with the
    same or a null doc_id are counted each for itself. Extra columns are ignored.
    """
    spark = documents.sparkSession
    with open(model_path, "rb") as f:
        raw = f.read()
    model, allowed = spark.sparkContext.broadcast(raw), cuts(raw)
    texts = documents.select("text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_memory()
        held: dict[int, list] = {}
        clash: list[list] = []

        def out() -> pa.RecordBatch:
            values = [*([key, *v] for key, v in held.items()), *clash]
            h, other = (pa.array(np.array([v[i] for v in values], np.uint64).view(np.int64)) for i in (0, 1))
            return pa.RecordBatch.from_arrays(
                [h, other, pa.array([v[2] for v in values], pa.binary()), pa.array([v[3] for v in values], pa.int64())],
                names=["h", "other", "pretoken", "times"],
            )

        for batch in batches:
            for _, part in slices(batch.column(0), _BYTES):
                h, other, begins, ends, _, data = pretokens(part, allowed)
                at, _, times = distinct_of(h, other)
                body = data.tobytes()
                for key, check, b, e, n in zip(*(x.tolist() for x in (h[at], other[at], begins[at], ends[at], times)), strict=True):
                    now = held.get(key)
                    if now is None:
                        held[key] = [check, body[b:e], n]
                    elif now[0] == check:
                        now[2] += n
                    else:
                        clash.append([key, check, body[b:e], n])
                if len(held) + len(clash) > HELD:
                    yield out()
                    held.clear()
                    clash.clear()
        yield out()
        held.clear()
        release_memory()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        extra = len(sp.encode("\n"))
        for batch in batches:
            strings = ["\n" + x.decode() for x in batch.column(2).to_pylist()]
            n = np.fromiter(map(len, sp.encode(strings, num_threads=1)), np.int64, len(strings)) - extra
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), batch.column(3)], names=["h", "other", "n", "times"])

    merged = texts.mapInArrow(distinct, "h long, other long, pretoken binary, times long").groupBy("h", "other")
    merged = merged.agg(F.min("pretoken").alias("pretoken"), F.sum("times").alias("times"))
    table = materialize(merged.mapInArrow(count, "h long, other long, n long, times long"))
    top = _frequent(table, head).select("h", "other", "n").toArrow()
    keys, others = (top.column(c).to_numpy().view(np.uint64) for c in ("h", "other"))
    _, order = np.unique(keys, return_index=True)
    common = spark.sparkContext.broadcast((keys[order], others[order], top.column("n").to_numpy()[order].astype(np.int32)))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, second, value = common.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, part in slices(batch.column(1), _BYTES):
                n = len(part)
                h, other, _, _, rows, _ = pretokens(part, allowed)
                first_at, back, _ = distinct_of(h, other)
                unique, check = h[first_at], other[first_at]
                at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
                hit = (known[at] == unique) & (second[at] == check) if len(known) else np.zeros(len(unique), bool)
                worth = np.where(hit, value[at] if len(known) else 0, 0)
                found = np.bincount(rows, weights=worth[back], minlength=n).astype(np.int64)
                rest = ~hit[back]
                pair, times = np.unique(np.stack([rows[rest], back[rest]]), axis=1, return_counts=True) if rest.any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                ids = row + np.arange(n, dtype=np.int64)
                m = pair.shape[1]
                size = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                spread = mix(ids.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([spread, unique[pair[1]].view(np.int64)])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), check[pair[1]].view(np.int64)])),
                        pa.array(np.concatenate([ids, ids[pair[0]]])),
                        pa.array(np.concatenate([np.zeros(n, np.int32), times.astype(np.int32)])),
                        pa.concat_arrays([batch.column(0).slice(first, n), pa.nulls(m, batch.column(0).type)]),
                        pa.concat_arrays([size, pa.nulls(m, pa.int64())]),
                        pa.array(np.concatenate([found, np.zeros(m, np.int64)])),
                    ],
                    names=["h", "other", "row", "times", "doc_id", "n_bytes", "found"],
                )
                row += n

    schema = f"h long, other long, row long, times int, doc_id {kind}, n_bytes long, found long"
    rows = documents.select("doc_id", "text").mapInArrow(frequencies, schema)
    joined = rows.join(table.select("h", "other", "n"), ["h", "other"], "left")
    tokens = F.sum(F.col("found") + F.col("times") * F.coalesce("n", F.lit(0)))
    summed = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
