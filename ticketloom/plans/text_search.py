"""Search and recommendation for typed questions: texts in, tickets out.

The encoder is fitted on the tickets; topics, tickets and questions become sparse vectors of
the same slots, and the two-level search runs on those as it does on any other vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions.keys import clean_id
from ticketloom.operators import search, sparse
from ticketloom.operators.scale import stored


@dataclass(frozen=True)
class TextIndex:
    """Slot weights with the encoded topics and tickets, both stored."""

    weights: np.ndarray
    topics: DataFrame
    tickets: DataFrame

    def asked(self, queries: DataFrame) -> DataFrame:
        """Questions with vectors: ``query_id, text`` and optionally the two filters."""
        kept = [c for c in ("query_id", "text", "system_filter", "team_filter") if c in queries.columns]
        return stored(sparse.encode(queries.select(*kept), self.weights).drop("text"))


def build(topics: DataFrame, tickets: DataFrame, features: int = sparse.FEATURES) -> TextIndex:
    """``topics``: ``topic_uid, system, text``; ``tickets``: ``id, topic_uids, text``, one row per ticket."""
    weights = sparse.slot_weights(tickets, features=features)
    encoded = (
        stored(sparse.encode(table.select(*columns, "text"), weights).drop("text"))
        for table, columns in ((topics, ("topic_uid", "system")), (tickets, ("id", "topic_uids")))
    )
    return TextIndex(weights, *encoded)


def text_search(
    index: TextIndex,
    queries: DataFrame,
    k_topics: int = 3,
    k_tickets: int = 5,
    topic_floor: float = names.TOPIC_FLOOR,
) -> DataFrame:
    """Best tickets per question, searched only in the question's best topics."""
    return search.hierarchical_search(index.asked(queries), index.topics, index.tickets, k_topics, k_tickets, topic_floor)


def text_similar(index: TextIndex, queries: DataFrame, details: DataFrame, k: int = 10, **options) -> DataFrame:
    """Similar tickets for support, with floors and filters."""
    return search.similar_tickets(index.asked(queries), index.topics, index.tickets, k, details=details, **options)


def questions_from_tickets(ids: DataFrame, tickets: DataFrame) -> DataFrame:
    """Questions from ticket ids: title and description of the ticket, a missing part as empty text.

    ``tickets``: ``id, title, description``; the first row of an id counts, by title and description.
    """
    wanted = ids.select(clean_id(F.trim(F.col("id").cast("string"))).alias("id")).distinct()
    empty = F.lit("")
    parts = F.struct(F.coalesce("title", empty).alias("title"), F.coalesce("description", empty).alias("description"))
    first = tickets.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(parts).alias("_parts"))
    text = F.concat("_parts.title", F.lit(" "), "_parts.description")
    return first.select(F.col("id").alias("query_id"), text.alias("text"))


def text_like_id(
    index: TextIndex, ids: DataFrame, texts: DataFrame, details: DataFrame, k: int = 10, **options
) -> DataFrame:
    """Tickets like a known one, found by its title and description; unknown ids give no rows."""
    return text_similar(index, questions_from_tickets(ids, texts), details, k, **options)


def text_recommend(index: TextIndex, queries: DataFrame, details: DataFrame, k: int = 3, **options) -> DataFrame:
    """One row per question: tier, best score, tickets in rank order and their pattern."""
    return search.recommend(index.asked(queries), index.topics, index.tickets, k, details=details, **options)
