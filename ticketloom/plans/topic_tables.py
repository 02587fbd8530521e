"""Consolidated topic tables and the recommender's two bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions import answers, keys, text
from ticketloom.operators import columns, tags
from ticketloom.operators.counts import tickets_per_topic, topic_spine
from ticketloom.operators.terms import first_keywords

TOPIC = ["system", "topic"]


def _on_spine(
    systems: DataFrame, assignments: DataFrame, summaries: DataFrame, titles: DataFrame
) -> DataFrame:
    """Every topic with its count, raw title and both summary fields.

    All sides but the assignments have one row per topic; the assignments are counted
    before they are joined.
    """
    parsed = summaries.select(
        *TOPIC,
        answers.dominant_pattern(F.col("text")).alias("pattern"),
        answers.operational_impact(F.col("text")).alias("impact"),
    )
    named = titles.select(*TOPIC, F.nullif(text.strip(F.col("text")), F.lit("")).alias("title"))
    return (
        topic_spine(systems)
        .join(tickets_per_topic(assignments), TOPIC, "left")
        .join(named, TOPIC, "left")
        .join(parsed, TOPIC, "left")
        .withColumns({c: F.coalesce(c, F.lit("")) for c in ("pattern", "impact")})
    )


def topic_table(
    systems: DataFrame,
    assignments: DataFrame,
    terms: DataFrame,
    summaries: DataFrame,
    titles: DataFrame,
) -> DataFrame:
    """One row per topic of every system, also of topics without data.

    ``systems``: ``system, k``; ``assignments``: ``system, id, topic``; ``terms``:
    ``system, topic, rank, term, score``; ``summaries`` and ``titles``: ``system, topic,
    text``.
    """
    words = first_keywords(terms)
    return (
        _on_spine(systems, assignments, summaries, titles)
        .join(words, TOPIC, "left")
        .select(
            *TOPIC,
            keys.default_title(F.col("title"), F.col("topic")).alias("title"),
            "pattern",
            "impact",
            text.keyword_string(F.col("terms")).alias("keywords"),
            F.coalesce("n_documents", F.lit(0).cast("bigint")).alias("n_documents"),
        )
    )


def review_table(
    systems: DataFrame, assignments: DataFrame, summaries: DataFrame, titles: DataFrame
) -> DataFrame:
    """Sheet for the reviewing specialist, notes left blank.

    The count is 0 for an empty topic and NULL for a system without any assignment.
    """
    known = assignments.select("system").distinct().withColumn("_known", F.lit(True))
    zero = F.when(F.col("_known"), F.lit(0).cast("bigint"))
    return (
        _on_spine(systems, assignments, summaries, titles)
        .join(known, "system", "left")
        .select(
            *TOPIC,
            F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce("n_documents", zero).alias("n_documents"),
            "pattern",
            "impact",
            F.lit("").alias("notes"),
        )
    )


def recommender_topics(table: DataFrame, with_keywords: bool = False) -> DataFrame:
    """Topic base of the recommender in its ten columns.

    The text to embed leaves the keywords out by default, as the search does.
    """
    keywords = F.col("keywords") if with_keywords else None
    return table.select(
        keys.topic_uid(F.col("system"), F.col("topic")).alias("topico_id_unico"),
        F.col("system").alias("sistema_origem"),
        F.col("topic").alias("topico_id_original"),
        F.col("title").alias("label_curto"),
        text.condensed_summary(F.col("pattern"), F.col("impact")).alias("resumo_sumarizado"),
        F.col("n_documents").alias("n_documentos"),
        "keywords",
        F.col("pattern").alias("padrao_dominante"),
        F.col("impact").alias("impacto_operacional"),
        text.topic_text(F.col("title"), F.col("pattern"), F.col("impact"), keywords).alias(
            "texto_para_embedding"
        ),
    ).select(*names.RECOMMENDER_TOPIC_ORDER)


def recommender_tickets(raw: DataFrame, assignments: DataFrame, position: str) -> DataFrame:
    """Ticket base of the recommender: one row per id, with tags, full text and link.

    ``raw`` has the input headers and a ``position`` column; ``assignments`` as in
    :func:`ticketloom.operators.tags.first_seen_tags`.
    """
    first = tags.first_per_id(raw, position, names.ID).drop(position)
    tagged = tags.first_seen_tags(assignments).select(
        F.col("id").alias(names.ID),
        tags.tag_string(F.col("topic_uids")).alias("topico_id_unico"),
        tags.tag_string(F.col("systems")).alias("sistema_origem"),
    )
    joined = first.join(tagged, names.ID, "left").fillna(
        {"sistema_origem": names.UNCLASSIFIED}
    )
    joined = columns.add_if_missing(joined, names.SOLUTION, F.lit(""))
    joined = columns.copy_if_missing(
        joined, names.HOURS_RECOMMENDER, names.HOURS_RECOMMENDER_ALT
    )
    full = text.full_text(_or_blank(joined, names.TITLE), _or_blank(joined, names.DESCRIPTION))
    link = text.first_url(columns.quoted(names.SOLUTION))
    return joined.withColumns({"texto_completo": full, "link_solucao": link}).transform(
        columns.preferred_order, names.RECOMMENDER_TICKET_ORDER
    )


def _or_blank(df: DataFrame, column: str):
    return columns.quoted(column) if column in df.columns else F.lit("")
