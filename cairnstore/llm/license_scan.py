"""License scans by diagonal voting, in DataFrame operations only.

Every document's rolling word pairs are hashed and joined to the positions of
the same pairs in the templates. A hit votes for its diagonal, the document
position less the template position. Votes are counted by diagonal, neighbouring
diagonals (words put in or left out) are merged, and a merged span is accepted
if enough of its template's pairs are there, within the length that they may
take. The phrases whose places are reported are templates like the others, with
all their pairs asked for.

The hit is where words are compared themselves, so a hash never decides. Only
hits and one row per document are shuffled, never texts. A pair travels with its
two words alone, so the work is linear in a text's length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a lower-cased text: letters and digits of ASCII, and everything beyond it.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases whose places are counted, and the sentences by which licenses are known.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license version 3": "gpl",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "gnu lesser general public license version": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc",
    "licensed under a creative commons attribution": "cc",
}
# Whole license texts, as their lower-cased words.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    " the software to deal in the software without restriction including without limitation the rights to use copy modify merge"
    " publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do"
    " so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or"
    " substantial portions of the software the software is provided as is without warranty of any kind express or implied including"
    " but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the"
    " authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or"
    " otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"
    " the above copyright notice and this permission notice appear in all copies the software is provided as is and the author"
    " disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no"
    " event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting"
    " from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in"
    " connection with the use or performance of this software": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
    " conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the"
    " following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
    " following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any"
    " damages arising from the use of this software permission is granted to anyone to use this software for any purpose including"
    " commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib",
}

#: Template pairs that are broadcast at most; a larger collection is joined by shuffle.
SMALL = 1_000_000


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool


def templates(phrases: dict[str, str] = PHRASES, sentences: dict[str, str] = SENTENCES, texts: dict[str, str] = TEXTS) -> list[Template]:
    kinds = ((phrases, True), (sentences, False), (texts, False))
    return [Template(tuple(text.split(" ")), label, base) for some, base in kinds for text, label in some.items()]


def _positions(spark: SparkSession, known: Sequence[Template]) -> DataFrame:
    """(t_h, t_id, t_at, t_a, t_b): a row for each pair of words of each template, and one for the end of a document."""
    rows = [
        f"({i}, {at}L, {_quoted(t.words[at])}, {_quoted(t.words[at + 1])})"
        for i, t in enumerate(known)
        for at in range(len(t.words) - 1)
    ]
    rows.append("(-1, 0L, '', '')")
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(t_id, t_at, t_a, t_b)")
    table = table.select(F.xxhash64("t_a", "t_b").alias("t_h"), "*")
    return F.broadcast(table) if len(rows) <= SMALL else table


def _facts(spark: SparkSession, known: Sequence[Template]) -> DataFrame:
    """(i_id, pairs, base, label) of each template; the end of a document is one with no pairs."""
    rows = [f"({i}, {len(t.words) - 1}L, {str(t.base).lower()}, {_quoted(t.label)})" for i, t in enumerate(known)]
    rows.append("(-1, 0L, false, '')")
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(i_id, pairs, base, label)")
    return F.broadcast(table) if len(rows) <= SMALL else table


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(documents: DataFrame, known: Sequence[Template] | None = None, coverage: float = 0.8, drift: int = 1) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are the
    smallest and largest start (null without a place). labels adds to base_labels
    those of templates of which `coverage` of the pairs stand in a span, with at
    most `drift` words put in or left out at a time. score is 1 with a base place,
    else the largest coverage of any span that was accepted, else 0.

    A null or empty text has no words and no labels ('' for both). Rows with one
    doc_id are scanned each for itself. A text's length is bounded by a row's alone.
    Extra columns are ignored. Templates need two words at least; whole license
    texts are templates like any other.
    """
    known = templates() if known is None else known
    if any(len(t.words) < 2 for t in known):
        raise ValueError("a template needs at least two words")
    spark = documents.sparkSession
    split = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), BREAKS)
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_remove(split, "").alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))

    def pair(a: Column, b: Column) -> Column:
        return F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b"))

    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))), pair)
    pairs = F.concat(pairs, F.array(pair(F.lit(""), F.lit(""))))
    grams = rows.select("row", "doc_id", "n_words", F.posexplode(pairs).alias("at", "pair"))
    joined = grams.join(_positions(spark, known), F.col("pair.h") == F.col("t_h"))
    same = (F.col("pair.a") == F.col("t_a")) & (F.col("pair.b") == F.col("t_b"))
    end = (F.col("t_id") == -1) & (F.col("at") == F.col("n_words"))
    hits = joined.where(end | ((F.col("t_id") >= 0) & same))
    hits = hits.select("row", "doc_id", "n_words", "t_id", F.col("at").cast("long").alias("at"), (F.col("at") - F.col("t_at")).alias("diagonal"))
    own = [F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words")]
    votes = hits.groupBy("row", "t_id", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), *own
    )
    votes = votes.join(_facts(spark, known), F.col("t_id") == F.col("i_id"))
    order = Window.partitionBy("row", "t_id").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(drift)
    spans = votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    spans = spans.groupBy("row", "t_id", "span", "pairs", "base", "label").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), *own
    )
    part = F.least(F.lit(1.0), F.col("votes") / F.greatest("pairs", F.lit(1)))
    full = (F.col("t_id") >= 0) & F.col("base") & (F.col("votes") == F.col("pairs"))
    loose = (F.col("t_id") >= 0) & ~F.col("base") & (part >= coverage)
    loose &= F.col("high") - F.col("low") + 2 <= (F.col("pairs") + 1) * 1.5
    spans = spans.withColumn("full", full).withColumn("ok", full | loose)

    def labels(flag: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col(flag), F.col("label")))), ",")

    return (
        spans.groupBy("row")
        .agg(
            *own,
            F.count(F.when(F.col("full"), 1)).alias("n_base"),
            F.min(F.when(F.col("full"), F.col("low"))).alias("first_word"),
            F.max(F.when(F.col("full"), F.col("low"))).alias("last_word"),
            labels("full").alias("base_labels"),
            labels("ok").alias("labels"),
            F.coalesce(F.max(F.when(F.col("full"), F.lit(1.0)).when(F.col("ok"), part)), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
