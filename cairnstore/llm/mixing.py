"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target divided by its size is the copies each of its words should get.
The whole part is certain: every document is taken that often. For the fraction, one
copy more, documents have unequal inclusion probabilities: their inclusion odds grow
with a power of their size. They are ranked by random odds u / (1 - u) over inclusion
odds and taken in that order as long as they fit what the source's target leaves; the
order needs the odds up to a factor only, which the cut then settles. Past the first
that doesn't fit, the next in rank that does is taken, up to FILLS times.

No source is gathered in one task: words are summed by bands of the ranking
first, then by narrower bands within the one in which the target falls, and only
the documents of the last (some millionths of a source) are ranked themselves. What
remains is one row per source, so the decision about a document needs its own row
and its source's row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_tools import broadcast_if_small, materialize, row_numbers

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bands of the ranking for which words are summed, and how often the band that matters is banded again.
BANDS, LEVELS = 1 << 10, 2
#: Documents taken past the first in rank that doesn't fit, at most.
FILLS = 4
#: Inclusion odds grow with this power of a document's size.
TILT = 0.5
#: So many sources at most are broadcast; beyond, documents and sources meet in a shuffled join.
SMALL = 50_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def draw(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A uniform number in (0, 1) by the document's id (its text, where it has none): the same in every run."""
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.when(F.col(doc_id).isNull(), F.col(text)))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def place(u: Column, size: Column, tilt: float) -> Column:
    """A document's place in (0, 1) in its source's ranking: its odds are u's odds over its inclusion odds."""
    return u / (u + (1 - u) * F.pow(F.greatest(size, F.lit(1)).cast("double"), F.lit(float(tilt))))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    sizes: (source, source_size). Sources by code point, null last, get the
    weights in turn. They share `share` of all words; a target stops at `most`
    times its source's size, and what is cut goes to the others by weight, until
    none is above. Only sums reach the driver.
    """
    numbered, _ = row_numbers(sizes, [F.col("source").isNull(), F.col("source")], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("_cap"))
    total, weight_sum = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = share * float(total or 0) / float(weight_sum or 1), -1
    while True:
        over = F.col("_cap") < F.col("weight") * level
        n, capped, rest = rows.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == full or not rest:
            break
        full, level = n, (share * float(total) - float(capped or 0)) / float(rest)
    return rows.select("source", "source_size", "weight", F.least("_cap", F.col("weight") * level).alias("target"))


def plan(drawn: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """The mix as one row per source: source, source_size, target, whole, below, cut, extras.

    drawn: (source, size, place). A document is taken `whole` times, and once more if
    its place is less than `below`, at most `cut` or one of `extras`. Rows of one place
    in a source (repeated rows) are taken or left together.
    """
    ranked = materialize(drawn.groupBy("source", "place").agg(F.sum("size").alias("words")))
    sizes = ranked.groupBy("source").agg(F.sum("words").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = targets(sizes, weights, share, most).withColumn("whole", F.floor(rate).cast("int"))
    per = materialize(per.withColumn("_need", F.col("target") - F.col("whole") * F.col("source_size")))
    n = per.count()
    start = per.where("_need > 0").select(F.col("source").alias("_s"), "_need", F.lit(0.0).alias("_low"), F.lit(0.0).alias("_upto"))
    turning = materialize(start)
    for level in range(LEVELS):
        turning = _narrowed(ranked, turning, n, float(BANDS) ** -level)
    inside = _beside(ranked, turning, n).where((F.col("place") >= F.col("_low")) & (F.col("place") < F.col("_low") + F.lit(float(BANDS) ** -LEVELS)))
    order = Window.partitionBy("_s").orderBy("place")
    inside = inside.withColumn("_through", F.col("_upto") + F.sum("words").over(order)).where(F.col("_through") <= F.col("_need"))
    reached = inside.groupBy("_s").agg(F.max("place").alias("_in"), F.max("_through").alias("_got"))
    reached = turning.join(broadcast_if_small(reached.withColumnRenamed("_s", "_t"), n, SMALL), F.col("_s").eqNullSafe(F.col("_t")), "left")
    cut = F.coalesce("_in", F.lit(-1.0))
    gap = F.col("_need") - F.coalesce("_got", "_upto")
    cuts = reached.select("_s", "_low", cut.alias("_cut"), cut.alias("_last"), gap.alias("_gap"), F.array().cast("array<double>").alias("_extras"))
    cuts = materialize(cuts)
    for _ in range(FILLS):
        fit = _beside(ranked, cuts, n)
        fit = fit.where((F.col("place") >= F.col("_low")) & (F.col("place") > F.col("_last")) & (F.col("words") > 0) & (F.col("words") <= F.col("_gap")))
        fill = fit.groupBy(F.col("_s").alias("_t")).agg(F.min(F.struct("place", "words")).alias("_next"))
        joined = cuts.join(broadcast_if_small(fill, n, SMALL), F.col("_s").eqNullSafe(F.col("_t")), "left")
        found = F.col("_next").isNotNull()
        cuts = materialize(
            joined.select(
                "_s",
                "_low",
                "_cut",
                F.coalesce("_next.place", "_last").alias("_last"),
                (F.col("_gap") - F.coalesce("_next.words", F.lit(0))).alias("_gap"),
                F.when(found, F.array_append("_extras", F.col("_next.place"))).otherwise(F.col("_extras")).alias("_extras"),
            )
        )
    out = per.join(broadcast_if_small(cuts, n, SMALL), F.col("source").eqNullSafe(F.col("_s")), "left")
    # A source that isn't among the cuts needs nothing beyond whole copies, or everything.
    below = F.when(F.col("_need") <= 0, F.lit(0.0)).otherwise(F.coalesce("_low", F.lit(1.0)))
    extras = F.coalesce("_extras", F.array().cast("array<double>"))
    out = out.select("source", "source_size", "target", "whole", below.alias("below"), F.coalesce("_cut", F.lit(-1.0)).alias("cut"), extras.alias("extras"))
    return materialize(out)


def _beside(ranked: DataFrame, per: DataFrame, n: int) -> DataFrame:
    """ranked with the columns of its source's row of per (with the source in _s); sources without one are left out."""
    return ranked.join(broadcast_if_small(per, n, SMALL), F.col("source").eqNullSafe(F.col("_s")))


def _narrowed(ranked: DataFrame, turning: DataFrame, n: int, width: float) -> DataFrame:
    """For each source the band, of BANDS in [_low, _low + width), in which its words exceed _need."""
    step = width / BANDS
    rows = _beside(ranked, turning, n).where((F.col("place") >= F.col("_low")) & (F.col("place") < F.col("_low") + F.lit(width)))
    band = F.floor((F.col("place") - F.col("_low")) / F.lit(step)).cast("int")
    bands = rows.groupBy("_s", "_need", "_low", "_upto", band.alias("_band")).agg(F.sum("words").alias("_words"))
    ordered = Window.partitionBy("_s").orderBy("_band")
    bands = bands.withColumn("_through", F.col("_upto") + F.sum("_words").over(ordered))
    turns = (F.col("_through") - F.col("_words") <= F.col("_need")) & (F.col("_through") > F.col("_need"))
    low = F.col("_low") + F.col("_band") * F.lit(step)
    return materialize(bands.where(turns).select("_s", "_need", low.alias("_low"), (F.col("_through") - F.col("_words")).alias("_upto")))


def _drawn(documents: DataFrame, seed: int, tilt: float, *columns: Column | str) -> DataFrame:
    """The given columns, source, size in words and place in the ranking of every document."""
    rows = documents.select(*columns, "source", word_count().alias("size"), draw(seed).alias("_u"))
    return rows.withColumn("place", place(F.col("_u"), F.col("size"), tilt)).drop("_u")


def _joined(df: DataFrame, per: DataFrame) -> DataFrame:
    """df (with source and place) beside its source's row; the extra columns start with an underscore."""
    small = per.select(*[F.col(c).alias(f"_{c}") for c in per.columns])
    out = df.join(broadcast_if_small(small, small.count(), SMALL), F.col("source").eqNullSafe(F.col("_source")), "left")
    more = (F.col("place") < F.col("_below")) | (F.col("place") <= F.col("_cut")) | F.array_contains("_extras", F.col("place"))
    return out.withColumn("_copies", F.col("_whole") + more.cast("int"))


def mix_documents(
    documents: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 0, tilt: float = TILT
) -> DataFrame:
    """Per document its size in words, its source's size and target, and the words the mix takes of it.

    A null text has no words. A null source is a source, last in order. Rows that
    share a doc_id (or, without one, a text), a source and a size are taken equally
    often. An empty table gives an empty result. Extra columns are ignored.
    """
    drawn = materialize(_drawn(documents, seed, tilt, "doc_id"))
    out = _joined(drawn, plan(drawn, weights, share, most))
    return out.select(
        "doc_id",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("size") * F.col("_copies")).alias("taken"),
    )


def mixed(
    documents: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 0, tilt: float = TILT
) -> DataFrame:
    """The mix itself: documents' own columns, each row as often as it is taken. Documents aren't shuffled when sources are few.

    Nulls, repeated rows and an empty table are treated as by mix_documents; extra
    columns are kept, whatever their names.
    """
    per = plan(materialize(_drawn(documents, seed, tilt)), weights, share, most)
    out = _joined(_drawn(documents, seed, tilt, F.struct(*documents.columns).alias("_row")), per).where("_copies > 0")
    return out.select(F.explode(F.array_repeat("_row", F.col("_copies"))).alias("_row")).select("_row.*")
