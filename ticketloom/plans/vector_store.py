"""Stored vectors by content: a text that did not change is never encoded again.

A row is keyed by id, digest of its text and fingerprint of the encoder. A refresh encodes the
rows the store lacks, adds them as one run and gives the vectors of the documents at hand, so a
changed text never keeps its old vector and a changed encoder starts anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.sources import runs
from ticketloom.sources.ledger import content_digest, digest

SCHEMA = "id string, digest string, encoder string, embedding array<float>"


def keyed(documents: DataFrame, text: str = "text") -> DataFrame:
    """``id, text`` with the digest of the text; a null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return documents.select(F.col("id").cast("string").alias("id"), body.alias("text"), F.sha2(body, 256).alias("digest"))


def stored_vectors(spark: SparkSession, path: str, encoder: str) -> DataFrame:
    """``id, digest, embedding`` of an encoder, one row for each text of an id."""
    rows = runs.read_runs(spark, path, SCHEMA).where(F.col("encoder") == encoder)
    return rows.groupBy("id", "digest").agg(F.min("embedding").alias("embedding"))


def missing(spark: SparkSession, path: str, documents: DataFrame, encoder: str) -> DataFrame:
    """Documents whose text the store has not met under this encoder."""
    return keyed(documents).join(stored_vectors(spark, path, encoder), ["id", "digest"], "left_anti")


def refresh(
    spark: SparkSession,
    path: str,
    documents: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    encoder: str,
) -> DataFrame:
    """``id, embedding`` of the documents; only new and changed texts go through ``encode``.

    ``encode`` takes ``id, text, digest`` and adds ``embedding``. The run is named after what it
    adds, so a repeated refresh adds nothing.
    """
    todo = missing(spark, path, documents, encoder).dropDuplicates(["id", "digest"])
    if not todo.isEmpty():
        encoded = encode(todo).select("id", "digest", F.lit(encoder).alias("encoder"), F.col("embedding").cast("array<float>").alias("embedding"))
        runs.append_once(encoded, path, digest(encoder, content_digest(todo, "id", "digest"))[:32])
    own = keyed(documents).select("id", "digest")
    return own.join(stored_vectors(spark, path, encoder), ["id", "digest"]).select("id", "embedding")
