"""Operators against brute force on small tables with nulls, ties, repeated rows, empty and long texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnstore.llm import (
    embedding_dedup,
    license_scan,
    mixing,
    ngram_join,
    packing,
    quality,
    queries,
    sharding,
    token_count,
    topk_search,
    url_filter,
    wordhash,
)
from cairnstore.llm.spark_tools import components, row_numbers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} and{i % 31}" for i in range(12_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "One two three",
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "THE quick brown fox jumps over the lazy dog near the river bank Today",
    "the quick brown fox jumps over the lazy dog near the river bank today again",
    "Released under the MIT License. MIT license, mit-license! Apache License and GNU General Public License",
    "This is licensed under CC BY-NC 4.0 and not the mit licensed kind",
    "Éa ça ▁ ▁▁x 12345 a\u3000b\x00c ÀÉ İstanbul ΟΔΟΣ cafe\u0301 <|endoftext|> <s> don't I'll",
    "a" * 50_000,
    LONG,
    LONG + " tail",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s0", 3), (None, "no id here at all, none", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(docs):
    """docs with extra columns under the names that results have."""
    extra = ["size", "shard", "slot", "row_number", "taken", "target", "score", "labels", "n", "class", "offset", "length", "u", "h", "row"]
    return docs.withColumns({c: F.lit("x") for c in extra})


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("x")).repartition(7)
    numbered, n = row_numbers(df, [F.col("k")], "at")
    assert n == 1000 and all(r["k"] == r["at"] for r in numbered.collect())


def test_components_of_chains_stars_and_cliques(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(500, 500), (None, 3)]
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (150, 2))]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    y = sharding.permute(x, n, 5)
    assert sorted(y) == list(x) and (sharding.invert(y, n, 5) == x).all()


def test_shards(docs, odd, empty):
    rows = rows_of(sharding.shard_documents(odd, 4))
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    texts = {i: t or "" for i, t in enumerate(TEXTS)}
    for r in rows:
        if r["doc_id"] is not None:
            raw = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert rows_of(sharding.shard_documents(empty)) == []
    again = rows_of(sharding.shard_documents(docs.repartition(5), 4))
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_shards_and_slots_are_those_of_the_permuted_row_numbers(spark):
    rows = [(i * 37 % 211, f"text {i * 37 % 211}") for i in range(211)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    places = sharding.permute(np.arange(211), 211, 0)
    for r in got:
        assert (r["shard"], r["slot"]) == (places[r["doc_id"]] % 8, places[r["doc_id"]] // 8)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = sum(w[s] for s in order if s not in capped)
        left = total - sum(most * sizes[s] for s in capped)
        over = {s for s in order if s not in capped and left * w[s] / rest > most * sizes[s]} if rest else set()
        if not over:
            return {s: most * sizes[s] if s in capped else left * w[s] / rest for s in order}
        capped |= over


def test_mix(spark, docs, odd, empty):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = rows_of(mixing.mix_documents(odd))
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += words(r["text"])
    want = brute_targets(dict(sizes))
    source = {(r["doc_id"], words(r["text"])): r["source"] for r in docs.collect()}
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert rows_of(mixing.mix_documents(empty)) == []


def test_mix_comes_near_its_targets_and_matches_the_mixed_rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, "w " * int(rng.integers(1, 60)), "en", "hot" if i % 3 == 0 else f"s{i % 4}", i) for i in range(3000)]
    df = spark.createDataFrame(data, SCHEMA)
    rows = rows_of(mixing.mix_documents(df))
    by, target = Counter(), {}
    source = {d[0]: d[3] for d in data}
    for r in rows:
        by[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert all(abs(by[s] - target[s]) <= 60 for s in target)
    copies = Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    assert {r["doc_id"]: r["taken"] // r["size"] for r in rows if r["taken"]} == dict(copies)
    assert mixing.mixed(df).columns == df.columns
    named = df.withColumns({"place": F.lit(1), "size": F.lit("x"), "_whole": F.lit(2)})
    assert mixing.mixed(named).columns == named.columns and mixing.mixed(named).count() == sum(copies.values())
    assert mixing.mixed(df.limit(0)).collect() == []


def brute_mix(rows, targets, fills, tilt):
    """Copies of (source, size, u) rows by going through each source's ranking one after the other."""
    out = {}
    for source, target in targets.items():
        own = sorted((u / (1 - u) / max(size, 1) ** tilt, size, i) for i, (s, size, u) in enumerate(rows) if s == source)
        total = sum(size for _, size, _ in own)
        whole = math.floor(target / total) if total else 0
        left, past = target - whole * total, 0
        for _, size, i in own:
            take = size <= left and (not past or (size and past <= fills)) and total and left > 0
            past += bool(take if past else not take)
            left -= size * bool(take)
            out[i] = whole + bool(take)
    return out


@pytest.mark.parametrize("tilt", [0.0, 0.5])
def test_mix_takes_what_a_sequential_pareto_ranking_takes(spark, tilt):
    rng = np.random.default_rng(11)
    data = [(i, "w " * int(rng.integers(0, 90)), "en", ["hot", "hot", "b", "c", None][i % 5], i) for i in range(2500)]
    df = spark.createDataFrame(data, SCHEMA)
    drawn = sorted(df.select("doc_id", "source", mixing.word_count().alias("size"), mixing.draw(0).alias("u")).collect())
    got = {r["doc_id"]: r for r in mixing.mix_documents(df, tilt=tilt).collect()}
    targets = {r["source"]: got[r["doc_id"]]["target"] for r in drawn}
    want = brute_mix([tuple(r)[1:] for r in drawn], targets, mixing.FILLS, tilt)
    assert {i: r["taken"] for i, r in got.items()} == {r["doc_id"]: r["size"] * want[i] for i, r in enumerate(drawn)}
    for source, target in targets.items():
        assert abs(sum(got[r["doc_id"]]["taken"] for r in drawn if r["source"] == source) - target) <= 45
    longer = [r["size"] > 45 for r in drawn if r["source"] == "hot" and got[r["doc_id"]]["taken"] and want[r["doc_id"]] > min(want.values())]
    assert longer and (tilt == 0 or np.mean(longer) > 0.5)


def test_packing_is_exact(docs, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[r["doc_id"], at // 4096, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = rows_of(packing.pack_documents(odd, path))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert rows_of(packing.pack_documents(empty, path)) == []


def test_word_ids_agree_with_the_tokenizer_for_every_code_point():
    words = packing.WordIds(open(queries.tokenizer("word_bpe_49k.json"), encoding="utf-8").read())
    points = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = ["Əliyev Bakı", "Ɓala Ɗan", *(f"x{c}Y {c}1{c}'s {c}{c} end" for c in points)]
    for at in range(0, len(texts), 8000):
        part = texts[at : at + 8000]
        want = words.tokenizer.encode_batch(part, add_special_tokens=False)
        assert words.encode(part) == [np.array(w.ids, "<u4").tobytes() for w in want]


def mixed_scripts(seed, n=300):
    """Random texts of several scripts, marks, digits, odd spaces and special strings."""
    rng = np.random.default_rng(seed)
    blocks = [(0x20, 0x7F), (0x41, 0x5B), (0x61, 0x7B), (0xA0, 0x250), (0x300, 0x340), (0x370, 0x400), (0x400, 0x460), (0x5D0, 0x5EB), (0x620, 0x650), (0x900, 0x980), (0xE00, 0xE50), (0x2000, 0x2070), (0x2580, 0x2590), (0x3040, 0x30FF), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0xFB00, 0xFB10), (0x1F600, 0x1F640)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 12))):
            low, high = blocks[int(rng.integers(len(blocks)))]
            parts.append("".join(map(chr, rng.integers(low, high, int(rng.integers(1, 9))))))
            parts.append([" ", "", "\n", "  ", "\t", "<s>", "'ll", "12"][int(rng.integers(8))])
        out.append("".join(parts))
    return out


def test_word_ids_agree_with_the_tokenizer_on_mixed_scripts():
    words = packing.WordIds(open(queries.tokenizer("word_bpe_49k.json"), encoding="utf-8").read())
    texts = mixed_scripts(0, 3000)
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert words.encode(texts) == [np.array(w.ids, "<u4").tobytes() for w in want]


def test_pieces_keep_their_ids(spark):
    df = spark.createDataFrame([(1, "Hello, wörld! " * 3000)], "doc_id long, text string")
    rows = sorted(rows_of(packing.pieces(df, queries.tokenizer("word_bpe_49k.json"), with_ids=True)), key=lambda r: r["piece"])
    assert len(rows) > 1 and all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [4, 40, 100, 10, 64, 101][seed], 400).tolist() + [100] * (seed % 3)
    counts = Counter(lengths)
    runs, sequences = packing.plan(counts, 100)
    bins = defaultdict(list)
    item = 0
    for k, (first, take, base, offset, length) in enumerate(runs.tolist()):
        stop = runs[k + 1][0] if k + 1 < len(runs) else len(lengths)
        assert first == item
        for j in range(stop - first):
            bins[base + j % take].append((offset + j // take * length, length))
        item = stop
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) == sequences and sorted(n for p in bins.values() for _, n in p) == sorted(lengths)
    open_bins = []
    for length in sorted(lengths, reverse=True):
        fit = [b for b in open_bins if b[0] >= length]
        if fit:
            min(fit)[0] -= length
        else:
            open_bins.append([100 - length])
    assert sequences == len(open_bins)


def test_token_counts(docs, odd, empty):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        n = len(sp.encode(t))
        want[r["doc_id"], len(t.encode()), n, n > 4096] += 1
    for head in (3, 1 << 10):
        rows = rows_of(token_count.token_counts(odd, path, head=head))
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert rows_of(token_count.token_counts(empty, path)) == []


def thue_morse(length, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(length))


#: Words on which polynomial hashes modulo a power of two collide.
TWINS = [thue_morse(n, letters) for n in (1024, 2048, 4096) for letters in ("ai", "ia", "бю", "юб")]


def test_word_fingerprints_tell_all_words_apart():
    rng = np.random.default_rng(5)
    some = {"".join(rng.choice(list("abéñ"), int(rng.integers(1, 30)))) for _ in range(20_000)}
    some |= {"a" * n for n in range(1, 600)} | {"a" * n + "b" for n in range(600)} | set(TWINS)
    first, second, at = wordhash.words(pa.array(sorted(some)))
    assert (np.diff(at) == 1).all() and len(set(first.tolist())) == len(set(second.tolist())) == len(some)


def test_token_counts_of_twin_words_and_mixed_scripts(spark):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = TWINS + mixed_scripts(7, 600)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(df, path, head=100).collect()}
    assert got == {i: len(ids) for i, ids in enumerate(sp.encode(texts))}


def test_pretokens_that_share_one_fingerprint_are_told_apart_by_the_other():
    h, other = np.array([7, 7, 3, 7, 3], np.uint64), np.array([1, 2, 1, 1, 1], np.uint64)
    at, back, times = token_count.distinct_of(h, other)
    assert [(int(h[i]), int(other[i])) for i in at] == [(3, 1), (7, 1), (7, 2)]
    assert back.tolist() == [1, 2, 0, 1, 0] and times.tolist() == [2, 2, 1]


def test_license_scan(docs, odd, empty):
    rows = rows_of(license_scan.scan(odd))
    assert len(rows) == docs.count()
    texts = dict(enumerate(TEXTS))
    for r in rows:
        if r["doc_id"] is None:
            continue
        low = re.sub("[A-Z]", lambda m: m.group(0).lower(), texts[r["doc_id"]] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, l) for p, l in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert r["first_word"] == (min(places)[0] if places else None)
        assert r["last_word"] == (max(places)[0] if places else None)
        assert r["base_labels"] == ",".join(sorted({l for _, l in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in rows}
    assert by[9]["base_labels"] == "apache,gpl,mit" and by[10]["labels"] == "cc" and by[10]["n_base"] == 0
    assert rows_of(license_scan.scan(empty)) == []


def test_license_spans_survive_words_put_in_and_left_out(spark):
    text = list(license_scan.SENTENCES)[0]
    cases = [text, text.replace("granted free", "granted entirely free"), text.replace("hereby ", ""), " ".join(text.split()[:6])]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert got == {0: "mit", 1: "mit", 2: "mit", 3: ""}


def test_license_scan_takes_time_in_proportion_to_a_text(spark):
    import time

    def scanned(words):
        text = " ".join(f"w{i % 5003}" for i in range(words)) + " released under the MIT license"
        df = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
        began = time.monotonic()
        assert license_scan.scan(df).first()["n_words"] == words + 5
        return time.monotonic() - began

    scanned(20_000)
    small, large = scanned(100_000), scanned(1_000_000)
    assert large < 13 * small


def test_license_texts_as_templates(spark):
    text = list(license_scan.TEXTS)[0]
    words = text.split()
    cases = ["x y z " + text.upper(), " ".join(words[:70] + ["oddly"] + words[70:]), " ".join(words[: len(words) // 2])]
    known = license_scan.templates(sentences={})
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(df, known).collect()} == {0: "mit", 1: "mit", 2: ""}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(ids, sets, num, den):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(x, least.get(r, x))
    return [least.get(find(i)) for i in range(len(ids))]


def corpus(seed, n=260):
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, int(rng.integers(3, 120)))) for _ in range(40)]
    out = []
    for i in range(n):
        words = list(base[0] if i % 3 == 0 else base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(len(words)))] = vocabulary[int(rng.integers(400))]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(0, 4, 85, 100), (1, 5, 80, 100), (2, 2, 60, 100)])
def test_ngram_components(spark, seed, k, num, den, monkeypatch):
    data = corpus(seed)
    for name, value in {"BLOCK_DOCS": 16, "CROWD": 6, "HELD": 500, "UNIT": 5}.items():
        monkeypatch.setattr(ngram_join, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(spark.createDataFrame(data, "doc_id long, text string"), k, num, den).collect()}
    sets = [shingles(t, k) for _, t in data]
    want = brute_components([i for i, _ in data], sets, num, den)
    assert got == {i: (len(s), c) for (i, _), s, c in zip(data, sets, want, strict=True)}


def test_ngram_components_of_odd_rows(docs, odd, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r["text"], 4) for r in rows]
    want = brute_components([r["doc_id"] for r in rows], sets, 85, 100)
    got = rows_of(ngram_join.ngram_components(odd, 4, 85, 100))
    assert Counter(map(str, ((r["doc_id"], len(s), c) for r, s, c in zip(rows, sets, want, strict=True)))) == Counter(
        str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got
    )
    assert rows_of(ngram_join.ngram_components(empty)) == []
    kept = ngram_join.without_near_copies(docs, 4, 85, 100)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 in ids and not {6, 7} & set(ids) and ids.count(3) == 1


@pytest.mark.parametrize("k", [4, 5])
@pytest.mark.parametrize("text", ["two words", "just three words"])
def test_a_short_document_alone_in_its_partition_has_one_shingle(spark, k, text):
    for which in (0, 1):
        alone = [s[which] for s in wordhash.shingle_sets(pa.array([None, text, ""]), k)]
        beside = [s[which] for s in wordhash.shingle_sets(pa.array([text, "a longer text of eight words beside it"]), k)]
        assert [len(s) for s in alone] == [0, 1, 0] and alone[1].tolist() == beside[0].tolist()
    df = spark.createDataFrame([(7, text)], "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in ngram_join.ngram_components(df, k).collect()] == [(7, 1, 7)]


def test_documents_of_one_word_link_only_if_they_are_equal(spark):
    df = spark.createDataFrame(list(enumerate(TWINS + TWINS[:2])), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(df, 4, 85, 100).collect()}
    assert got == {i: i % len(TWINS) for i in range(len(TWINS) + 2)}


def test_near_copies_go_by_row_not_by_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (None, a + " more"), (None, ""), (None, c), (5, b), (5, b + " more"), (5, ""), (5, "another text of the same id")]
    kept = ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["text"]) for r in kept.collect()}
    either = got & {(5, b), (5, b + " more")}
    assert len(either) == 1
    assert got - either == {(1, a), (None, ""), (None, c), (5, ""), (5, "another text of the same id")}


@pytest.mark.parametrize("every", [False, True])
def test_verify_units(every):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.05, rng.integers(0, 1 << 62, 60).astype(np.uint64), base)) for _ in range(30)]
    side = np.array([0] * 15 + [1] * 15)
    want = set()
    for i in range(15):
        for j in range(15, 30):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want.add((i, j))
    got = set(ngram_join.verify(sets, side, 85, 100, every=every))
    assert want and (got == want if every else got <= want)
    assert not set(ngram_join.verify(sets, side, 85, 100, [0] * 30))


def hot_documents(spark, n):
    """n documents of twelve words with one 4-gram in common, and no other."""
    words = F.array(F.lit("one"), F.lit("and"), F.lit("the"), F.lit("same"), *[F.concat(F.lit(f"w{j}x"), F.col("id")) for j in range(8)])
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))


def test_an_ngram_of_all_documents_makes_no_pairs(spark):
    docs = hot_documents(spark, 100_000)
    signed = ngram_join.signatures(docs, 4)
    assert ngram_join.prefixes(docs, ngram_join.rarity(signed), 4, 85, 100).count() < 1000
    # Also where the n-gram is in every prefix, entries are paired with two leaders at most, and none fit.
    entries = ngram_join.prefixes(docs, np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8), 4, 10, 100)
    entries = entries.select("h", F.xxhash64("high", "low").alias("class"), "n", "at")
    assert entries.count() == 100_000 and ngram_join.led(entries, 10, 100).count() <= 200_000


def test_ngrams_shared_by_chance_leave_no_entries(spark, monkeypatch):
    # Two sets that can't overlap enough at the one n-gram that they share.
    texts = [" ".join(["one and the same", *(f"{x}{i}" for i in range(n))]) for x, n in (("a", 40), ("b", 400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ngram_join.prefixes(docs, np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8), 4, 10, 100).count() == 0
    # A sketch far too small for the corpus: n-grams of common words meet often, but rarer ones come first.
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 12)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([*(f"c{x}" for x in rng.integers(0, 6, 60)), *(f"r{i}x{j}" for j in range(30))])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.prefixes(docs, ngram_join.rarity(ngram_join.signatures(docs, 4)), 4, 85, 100).count() < 200


def test_near_copies_linked_only_through_the_text_they_come_from(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 700):
        words = list(base)
        words[int(rng.integers(4, 56))] = f"new{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 100)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert {r["component_id"] for r in got.collect()} == {0}


@pytest.mark.parametrize("paired", [3, 20, 512])
def test_crowds_are_listed_or_cut_into_blocks(spark, monkeypatch, paired):
    data = corpus(3, 200)
    for name, value in {"BLOCK_DOCS": 16, "CROWD": 3, "PAIRED": paired}.items():
        monkeypatch.setattr(ngram_join, name, value)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(data, "doc_id long, text string"), 4, 85, 100).collect()}
    want = brute_components([i for i, _ in data], [shingles(t, 4) for _, t in data], 85, 100)
    assert got == {i: c for (i, _), c in zip(data, want, strict=True)}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_texts_that_share_ngrams_by_chance_meet_in_no_block(spark, monkeypatch, k, num):
    """Long texts with 40 passages in common, an eighth of each text: as a crowd their sets were all fetched, to be compared with each other."""
    passages = [" ".join(f"p{p}x{j}" for j in range(k)) for p in range(40)]
    rows = [(i, " ".join(x for p in passages for x in (p, *(f"r{i}y{p[:4]}{j}" for j in range(5))))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fetched, sets = [], ngram_join._sets
    monkeypatch.setattr(ngram_join, "_sets", lambda d, c, wanted, k: fetched.append(wanted.count()) or sets(d, c, wanted, k))
    monkeypatch.setattr(ngram_join, "rarity", lambda signed: np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8))
    got = ngram_join.ngram_components(docs, k, num, 100)
    assert all(r["component_id"] == r["doc_id"] for r in got.collect()) and sum(fetched) == 0


def test_documents_without_ids_are_told_apart_by_their_texts(spark):
    rows = [(None, " ".join(f"{k // 2}w{j}" for j in range(40)) + " end" * (k % 2)) for k in range(60)]
    kept = ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert kept.count() == 30


def test_quality_learns_and_ignores_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_documents(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in got.score[got.quality == 1] for b in got.score[got.quality == 0]])
    assert auc > 0.95 and ((got.score >= 0.3) == (got.predicted == 1)).all()
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = (quality.score_documents(docs, x).orderBy("doc_id").toPandas().score for x in (labels, flipped))
    assert np.allclose(a, b)


def plain_features(text):
    """The features of a text by their definition, over words and bytes one by one."""
    raw, out = (text or "").encode(), set()
    mixed = lambda h: int(wordhash.mix(np.array([h % 2**64], np.uint64))[0])
    bucket = lambda code, salt: mixed(code + (salt << 56)) >> (64 - quality.BITS)
    for n in (2, 3):
        out |= {bucket(int.from_bytes(g, "big"), n) for g in {raw[i : i + n] for i in range(len(raw) - n + 1)}}
    kind = lambda c: 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 4 if 48 <= c <= 57 else 8 if c >= 128 else 16
    shape, coarse, before = [], [], None
    for word in re.findall(rb"[^\x20\x09-\x0D]+", raw):
        kinds = 0
        for c in set(word):
            kinds |= kind(c)
        last, same = word[-1] if kind(word[-1]) == 16 else 0, int(word == before)
        shape.append((((kinds << 5 | kind(word[0])) << 8 | last) << 3 | min(len(word).bit_length() - 1, 7)) << 1 | same)
        coarse.append((kinds << 8 | last) << 1 | same)
        before = word
    out |= {bucket(x, 8) for x in shape}
    two = [mixed(a + 2 * b) for a, b in zip(coarse, coarse[1:], strict=False)]
    three = [mixed(a + 3 * b) for a, b in zip(two, coarse[2:], strict=False)]
    return out | {bucket(x, 10) for x in set(two)} | {bucket(x, 11) for x in set(three)}


def test_quality_features_are_those_of_the_whole_text(monkeypatch):
    texts = [t for t in TEXTS if t is None or len(t) < 60_000] + ["stop pots pots stop stop", LONG[:40_000]] + mixed_scripts(3, 40)
    want = [plain_features(t) for t in texts]
    for segment in (1 << 18, 700):
        monkeypatch.setattr(wordhash, "SEGMENT", segment)
        assert [set(x.tolist()) for x in quality.features(pa.array(texts))] == want


def plain_descent(rows, scale, y, cost, rounds, seed):
    w, bias, alpha = Counter(), 0.0, [0.0] * len(rows)
    values = []
    for x in rows:
        length = math.sqrt(sum(scale[i] ** 2 for i in x))
        values.append({i: scale[i] / length if length else scale[i] for i in x})
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (sum(w[j] * v for j, v in values[i].items()) + bias) - 1
            new = min(max(alpha[i] - gradient / (sum(v * v for v in values[i].values()) + 1), 0.0), cost)
            step, alpha[i] = (new - alpha[i]) * y[i], new
            for j, v in values[i].items():
                w[j] += step * v
            bias += step
            moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w, bias


def test_dual_descent_is_the_plain_one():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 50, 12)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    scale = rng.standard_normal(50)
    w, bias = quality._dual_descent(rows, scale, y, 1.0, 8, 0)
    plain, plain_bias = plain_descent([r.tolist() for r in rows], scale.tolist(), y.tolist(), 1.0, 8, 0)
    assert bias == pytest.approx(plain_bias) and w == pytest.approx([plain[i] for i in range(50)])


def test_quality_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows = [(i, f"text number {i} " * (1 + i % 7)) for i in range(60)] + [(7, "again and again")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    fitted = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **more: seen.append(x) or fitted(x, y, **more))
    quality.train(docs, labels)
    quality.train(docs, labels, sample=20)
    quality.train(docs, labels, most_bytes=4000)
    inside = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))
    assert [len(x) for x in seen[:2]] == [inside, 20]
    assert 0 < len(seen[2]) < inside and 4 * sum(map(len, seen[2])) <= 4000


def test_quality_of_odd_rows(spark, docs, odd, empty):
    labels = spark.createDataFrame([(5, 1), (9, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    rows = rows_of(quality.score_documents(odd, labels))
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in rows_of(quality.score_documents(docs, none))} == {0.5}
    assert rows_of(quality.score_documents(empty, labels)) == []
    assert quality.accepted(odd, labels).columns == odd.columns


def vectors(spark, seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((25, d))
    x = base[rng.integers(0, 25, n)] + 0.12 * rng.standard_normal((n, d))
    x[:60] = x[0]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    data += [(1000, None), (1001, [0.0] * d), (1002, [float("nan")] * d), (1003, [None] + [1.0] * (d - 1)), (1004, []), (1005, [float("inf")] * d), (None, data[3][1])]
    data += [(1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [-1.0, -2.0]), (1009, [3.0])]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>"), data


def usable(v):
    return v is not None and len(v) > 0 and all(a is not None and math.isfinite(a) for a in v)


def test_spherical_caps(spark, monkeypatch):
    df, data = vectors(spark)
    rows = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df.withColumn("n_links", F.lit(1))).collect()}
    good = [(i, np.array(v, np.float64)) for i, v in data if i is not None and usable(v) and any(v)]
    links, parent = Counter(), {i: i for i, _ in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    found = sum(rows[i]["n_links"] for i, _ in good)
    assert all(rows[i]["n_links"] <= links[i] for i, _ in good) and found >= 0.97 * sum(links.values())
    assert sum(rows[i]["component_id"] != find(i) for i, _ in good) <= 3
    for i in (1000, 1001, 1002, 1003, 1004, 1005):
        assert (rows[i]["n_links"], rows[i]["component_id"], rows[i]["kept"]) == (0, i, True)
    assert rows[None]["n_links"] == 0 and not rows[None]["kept"] and len(rows) == len(data)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_spherical_caps_of_repeated_ids(spark):
    v, w, z = [1.0, 0.0, 0.0, 0.0], [0.999, 0.01, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(5, v), (5, v), (3, w), (5, z), (9, z), (2, None), (2, v)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(5, 3, 2), (5, 3, 2), (3, 3, 2), (5, 1, 5), (9, 1, 5), (2, 0, 2), (2, 3, 2)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)


def test_spherical_caps_in_blocks(spark, monkeypatch):
    df, _ = vectors(spark, 4)
    whole = sorted(map(str, embedding_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    assert sorted(map(str, embedding_dedup.near_duplicates(df).collect())) == whole


def pairs_at(cosine, m, d, seed=0):
    x, y = np.random.default_rng(seed).standard_normal((2, m, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * y / np.linalg.norm(y, axis=1, keepdims=True)


def test_spherical_caps_find_pairs_at_the_threshold(spark):
    x, y = pairs_at(0.9501, 3000, 64)
    data = [(i, v) for i, v in enumerate(np.concatenate([x, y]).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(df).where("n_links > 0").count() >= 2 * 2998


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_spherical_caps_of_short_vectors(spark, d):
    x = np.random.default_rng(d).standard_normal((60, d))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = ((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    assert [r["n_links"] for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()] == expected


@pytest.mark.parametrize(("n", "cosine"), [(51_282, 0.95), (1_000_000, 0.95), (1_000_000, 0.97), (4_000_000, 0.95)])
def test_spherical_codes_keep_their_recall_as_tables_grow(n, cosine):
    least, words, number = embedding_dedup.sizes(n, cosine, 64)
    codes = [embedding_dedup.Code(64, words, 0, k) for k in range(number)]
    x, y = pairs_at(cosine, 4000, 64)
    (a, f), (b, g) = (embedding_dedup.filters_of(v, codes, least) for v in (x, y))
    both = set(zip(a.tolist(), f.tolist(), strict=True)) & set(zip(b.tolist(), g.tolist(), strict=True))
    assert len({row for row, _ in both}) >= 3996
    assert len(a) / len(x) <= 1.1 * number


def test_m_tree_search(spark, monkeypatch):
    df, data = vectors(spark, 2)
    monkeypatch.setattr(topk_search, "BLOCK", 50)
    monkeypatch.setattr(topk_search, "PACKET", 3)
    x = {i: [math.floor(256 * float(np.float32(a))) for a in v] for i, v in data if i is not None and usable(v)}
    want = []
    for q in (i for i in x if i % 7 == 0):
        scores = sorted((-sum(a * b for a, b in zip(x[q], v, strict=True)), i) for i, v in x.items() if i != q and len(v) == len(x[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    got = topk_search.search_embeddings(df.withColumn("rank", F.lit(0)), every=7).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk_search.search_embeddings(df.limit(0)).collect() == []


def brute_top(rows, asked, k=5):
    """rows: (vec_id, integer vector). Each asked id's best rows of other ids."""
    out = []
    for q in asked:
        own = [v for i, v in rows if i == q][0]
        scores = sorted((-int(own @ v), i) for i, v in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_m_tree_prunes_blocks_of_a_deep_tree(spark, monkeypatch):
    for name, value in {"BLOCK": 25, "FAN": 4, "PACKET": 7, "PACKETS": 2}.items():
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 12)) * 2
    x = np.floor(256 * (np.repeat(centres, 40, axis=0) + 0.02 * rng.standard_normal((1600, 12))))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, x array<double>")
    visited = []
    descend = topk_search.descended
    monkeypatch.setattr(topk_search, "descended", lambda *a: visited.append(topk_search.materialize(descend(*a))) or visited[0])
    got = topk_search.top_k(df, df.where("vec_id % 16 = 0"))
    rows = list(enumerate(x.astype(np.int64)))
    assert sorted(map(tuple, got.collect())) == brute_top(rows, range(0, 1600, 16))
    pairs = visited[0].select(F.sum(F.size("queries"))).first()[0]
    assert pairs < 0.35 * 100 * (1600 / 25)


def test_m_tree_search_with_repeated_ids_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 10)
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (120, 6))
    ids = [0] * 30 + [50] + list(range(100, 189))
    x[40:100] = x[30]
    rows = list(zip(ids, x, strict=True)) + [(120, x[3])] * 12
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in rows], "vec_id long, x array<double>")
    got = topk_search.top_k(df, df.where("vec_id in (50, 100, 188)"))
    assert sorted(map(tuple, got.collect())) == brute_top(rows, [50, 100, 188])


def test_m_tree_search_of_large_components(spark):
    data = [(i, [float((i * 37) % 11 - 5) * 1e6, 1.0 + i]) for i in range(20)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    x = {i: [math.floor(256 * a) for a in v] for i, v in data}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.search_embeddings(df, every=10).collect()}
    for q in (0, 10):
        scores = sorted((-(x[q][0] * x[i][0] + x[q][1] * x[i][1]), i) for i in x if i != q)
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in scores[:5]]


def test_url_rules(spark):
    urls = [
        None, "", "example.com/en/1", "HTTP://WWW.Example.COM/en/1", "http://a.example.com/en/", "https://x.net/es/1?q#f", "https://net/fr/",
        "https://notnet/fr/", "http://example.com", "ftp://m.example.com:80/en/1", "x://y://com/a", "http://com/", "http://shop.com?x=/en/",
    ]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    for r in url_filter.judge(df.withColumn("host", F.lit("z"))).collect():
        u = urls[r["page_id"]] or ""
        h = p = ""
        if "://" in u:
            h, p = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            h = h.lower()
        fit = [x for x in url_filter.RULES if (h == x.host or h.endswith("." + x.host)) and p.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.host + x.path)) if fit else None
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (h, p, best and best.host + best.path, best.action if best else "allow")
    assert url_filter.judge(df.limit(0)).collect() == []


def test_url_aliases(spark):
    link = '<html><head><link href="{}" rel="canonical"></head></html>'
    pages = [
        (1, "http://a.org/x", link.format("https://b.net/es/1")),
        (2, "http://a.org/y", link.format("/x")),
        (3, "http://a.org/z", '<meta http-equiv="refresh" content="0; url=http://a.org/y">'),
        (4, "http://c.org/1", link.format("http://www.example.com/en/9")),
        (5, "http://c.org/2", link.format("http://q.example.com/en/9")),
        (6, "http://c.org/3", link.format("//c.org/2")),
        (7, "http://d.org/1", link.format("http://c.org/1")),
        (8, "http://d.org/2", None),
        (9, "http://A.org/x#part", "no links"),
        (10, "https://e.net/fr/1", link.format("http://www.example.com/en/9")),
    ]
    redirects = spark.createDataFrame([("http://c.org/3", "http://d.org/1"), (None, "http://d.org/2")], "source string, target string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, redirects=redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block"}
    alone = {r["page_id"]: r["verdict"] for r in url_filter.judge(df).collect()}
    assert alone[5] == alone[6] == "block" and alone[7] == "allow"


def test_url_links_are_all_found(spark):
    pages = [
        (1, "http://a.org/x", '<!-- <link rel="canonical" href="http://www.example.com/en/"> --><link rel=canonical href="">'),
        (2, "http://a.org/y", '<link rel="stylesheet" href="http://www.example.com/en/1"><LINK href=http://q.example.com/en/9 rel="alternate canonical">'),
        (3, "http://a.org/z", '<link rel="canonical" href=""><meta http-equiv="refresh" content="1"><meta content="5;URL=\'/y\'" http-equiv="Refresh">'),
        (4, "http://a.org/v", '<link rel="canonical" href="/nowhere"><link rel="canonical" href="/z">'),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "block"}


def test_url_aliases_of_chains_cycles_and_hubs(spark):
    n = 10_000
    hub = [(f"http://hub.org/{i}", "http://q.example.com/en/hub") for i in range(n)]
    chain = [(f"http://chain.org/{i}", f"http://chain.org/{i + 1}") for i in range(300)] + [("http://chain.org/300", "http://x.net/es/1")]
    cycle = [(f"http://cycle.org/{i}", f"http://cycle.org/{(i + 1) % 50}") for i in range(50)] + [("http://cycle.org/7", "http://www.example.com/en/")]
    cycle.append(("http://q.example.com/en/7", "http://cycle.org/9"))
    edges = [*hub, *chain, *cycle, ("http://loop.org/", "http://loop.org/"), (None, "http://hub.org/1"), *hub[:100]]
    pages = [(i, f"http://hub.org/{i}", None) for i in range(0, n, 10)] + [(n + i, f"http://chain.org/{i}", None) for i in range(300)]
    pages += [(2 * n + i, f"http://cycle.org/{i}", None) for i in range(50)] + [(3 * n, "http://loop.org/", None), (3 * n, "http://loop.org/", None)]
    pages += [(4 * n, None, None)] * 200 + [(4 * n + 1, "http://hub.org/1", None)] * 300 + [(None, "http://chain.org/5", None), (5 * n, "http://" + "a." * 50_000 + "org/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = url_filter.judge(df, redirects=spark.createDataFrame(edges, "source string, target string")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = "block" if r["host"] in ("hub.org", "chain.org") else "allow"
        assert r["verdict"] == want and r["rule"] is None


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
    kept = now.toPandas()
    ids = set(kept.doc_id)
    data = docs.where(F.col("doc_id").isin(list(ids))).collect()
    sets = [shingles(r["text"], 5) for r in data]
    assert len(set(brute_components([r["doc_id"] for r in data], sets, 80, 100))) == len(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).toPandas()
    assert sorted(packed[packed.piece == 0].doc_id) == sorted(kept.doc_id)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_packets_of_queries_are_small_and_may_go_without_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (600, 64)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>").coalesce(1)
    packed = topk_search._packed(rows)
    sample = {64: x[:100]}
    leaves = topk_search._leaves(packed, sample)
    asked = packed.withColumnRenamed("vec_id", "query").withColumn("bound", F.lit(float("-inf")))
    met = topk_search.descended(asked, topk_search.tree(leaves))
    most, n = met.agg(F.max(F.octet_length("body")), F.sum(F.size("queries"))).first()
    assert most <= 1 << 16 and n == 600 * leaves.count()
    want = []
    for i in range(0, 600, 60):
        scores = sorted((-int(x[i] @ x[j]), j) for j in range(600) if j != i)
        want += [(i, rank + 1, j, -score) for rank, (score, j) in enumerate(scores[:5])]
    for limit in (1 << 26, 0):
        monkeypatch.setattr(topk_search, "SHARED_BYTES", limit)
        assert sorted(tuple(r) for r in topk_search.top_k(rows, rows.where("vec_id % 60 = 0")).collect()) == want
