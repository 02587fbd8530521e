"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor wrote and its decisions take effect: rows without a
language go, one row of each exact text and one of each group of near copies stays, the mix
repeats or drops rows, and the last stage cuts and packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.llm import best_two_fit, curriculum, extendible, mixture_langid, storage, tensor_minhash

# No single SQL statement infers mixtures, searches candidates or packs greedily; the stages
# are held against brute force in tests/llm.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those that are null or hold no letter go."""
    return mixture_langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id."""
    return extendible.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words."""
    return tensor_minhash.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    return curriculum.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their place in a sequence."""
    return best_two_fit.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
