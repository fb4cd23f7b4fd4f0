"""A training corpus from documents: quality, near copies, mix, packing.

Each stage reads all that its predecessor kept, as a table, and its decisions take
effect. All but the last return the columns of documents; the last returns the
pieces of the documents with their places in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnstore.llm import mixing, ngram_join, packing, quality
from cairnstore.llm.queries import tokenizer
from cairnstore.llm.spark_tools import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more."""
    return ngram_join.without_near_copies(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, best-fit packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the tokenizer and connected components of text similarity are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
