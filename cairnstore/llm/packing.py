"""Best-fit packing planned on the length histogram.

Documents become pieces of at most `capacity` tokens. Only the number of pieces
of each length reaches the driver; best-fit decreasing runs over those counts,
placing all pieces of a length that share a remaining capacity at once, so the
plan's size depends on the capacity and not on the corpus. Pieces numbered by
length then take the planned slots: a piece's rank within its length is its
number less the number of longer pieces.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import materialize, row_numbers
from .wordhash import kept, release_memory

CAPACITY = 4096
END_ID = 1
#: Words kept with their ids in a worker, twice: when the table is full, it is the older one, of which words in use return.
CACHE = 150_000
BATCH_BYTES = 1 << 21

#: The pre-tokenizer's contractions, in its order.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

_LAST = 0x24F
_ODD = {0x85, 0x1C, 0x1D, 0x1E, 0x1F}


def _ranges(wanted: Callable[[str], bool]) -> str:
    """A character class body for the wanted characters up to _LAST."""
    at = [c for c in range(_LAST + 1) if wanted(chr(c))]
    out, start = [], None
    for c in at:
        start = c if start is None else start
        if c + 1 not in at:
            out.append(f"\\u{start:04x}-\\u{c:04x}")
            start = None
    return "".join(out)


_L, _N = (_ranges(lambda c, kind=kind: unicodedata.category(c)[0] == kind) for kind in "LN")
_S = r"\t-\r \xa0"
#: What the fast path splits at: for its characters the same as the tokenizer's own pattern.
_WORDS = re.compile(f"{CONTRACTIONS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Characters for which the fast path isn't shown to agree: beyond _LAST, or lower-cased to beyond it, and odd white space.
_OTHER = re.compile("[^" + _ranges(lambda c: ord(c) not in _ODD and max(map(ord, c.lower())) <= _LAST) + "]")


class WordIds:
    """Token ids of whole texts through a table of words.

    The tokenizer lower-cases, drops white space and merges within a word only,
    so a text's ids are its words' ids in a row. Texts with characters for which
    the words found here could differ from the tokenizer's, or with a special
    token's string, go to the tokenizer whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = json.loads(tokenizer_json)["model"]["end_of_word_suffix"]
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split: list[list[str] | None] = []
        fresh: set[str] = set()
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        for text in texts:
            if _OTHER.search(text) or any(s in text for s in self.special):
                split.append(None)
            else:
                found = _WORDS.findall(text.lower())
                split.append(found)
                fresh.update(found)
        fresh.difference_update(self.known)
        again = fresh.intersection(self.older)
        self.known.update((word, self.older[word]) for word in again)
        new = list(fresh - again)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closing[ids]) + 1)).tolist()
            body = ids.tobytes()
            for word, a, b in zip(part, [0, *ends], ends, strict=False):
                self.known[word] = body[a:b]
            if len(ends) != len(part):
                raise ValueError("the tokenizer doesn't end each word with one closing piece")
        get = self.known.__getitem__
        return [self._whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


def batches_by_bytes(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Texts (null: empty) in runs of about `limit` bytes, each with its first row."""
    start, held, out = 0, 0, []
    for k in range(len(column)):
        text = column[k].as_py() or ""
        out.append(text)
        held += len(text)
        if held >= limit:
            yield start, out
            start, held, out = k + 1, 0, []
    if out:
        yield start, out


def pieces(
    documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32, if asked for)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    kind = documents.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = kept(f"words {zlib.crc32(model.value.encode())}", lambda: WordIds(model.value))
        for batch in batches:
            for first, texts in batches_by_bytes(batch.column(1)):
                rows, piece, start, length, crc, bodies = [], [], [], [], [], []
                for k, ids in enumerate(words.encode(texts), first):
                    ids += end
                    for at in range(0, len(ids), 4 * capacity):
                        part = ids[at : at + 4 * capacity]
                        rows.append(k)
                        piece.append(at // (4 * capacity))
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            bodies.append(part)
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(bodies, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release_memory()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts of lengths.

    Returns runs and the number of sequences. Items are numbered by length, the
    longest first; a run (first item, sequences, first sequence, offset, length)
    deals its items over its sequences in turn, from that offset on.
    """
    open_at: dict[int, list[list[int]]] = {}
    room: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    item = sequences = 0

    def leave(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in open_at:
                open_at[space] = []
                bisect.insort(room, space)
            open_at[space].append([first, count])

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no sequence holds a piece of {length}")
        left = counts[length]
        while left:
            at = bisect.bisect_left(room, length)
            space = room[at] if at < len(room) else capacity
            each = space // length
            if at < len(room):
                group = open_at[space][-1]
                first, available = group
            else:
                first, available = sequences, left // each + 1
            take = min(available, left // each)
            fill = each if take else left
            take = take or 1
            runs.append((item, take, first, capacity - space, length))
            item += take * fill
            left -= take * fill
            if at < len(room):
                group[0] += take
                group[1] -= take
                if not group[1]:
                    open_at[space].pop()
                    if not open_at[space]:
                        del open_at[space]
                        room.pop(at)
            else:
                sequences += take
            leave(space - fill * length, first, take)
    return np.array(runs, np.int64).reshape(-1, 5), sequences


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset.

    parts: doc_id, piece, length (1 to capacity) and any other columns, which are
    kept; sequence_id and offset are replaced. Equal rows get slots of their own.
    Sequences are gapless from offset 0. An empty table gives an empty result.
    """
    parts = parts.drop("sequence_id", "offset")
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece")]
    numbered, _ = row_numbers(parts, order, "_item")
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = parts.sparkSession.sparkContext.broadcast(plan(counts, capacity)[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, take, first, offset, length = runs.value.T
        for batch in batches:
            at = batch.schema.get_field_index("_item")
            n = batch.column(at).to_numpy(zero_copy_only=False)
            run = np.searchsorted(item, n, "right") - 1
            k = n - item[run]
            sequence = first[run] + k % take[run]
            where = offset[run] + k // take[run] * length[run]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(where)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its place. A null text is empty: it is the end id alone."""
    return pack(materialize(pieces(documents, tokenizer_path, capacity, end_id)), capacity)
