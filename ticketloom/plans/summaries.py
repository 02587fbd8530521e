"""Batches for the language model and tables from its answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions import answers, text
from ticketloom.operators.scale import stored
from ticketloom.operators.selection import select_tickets
from ticketloom.operators.terms import first_keywords

TOPIC = ["system", "topic"]


def pending(topics: DataFrame, done: DataFrame) -> DataFrame:
    """Topics without a stored result: an interrupted run goes on from here."""
    return topics.join(done.select(*TOPIC).distinct(), TOPIC, "left_anti")


def ticket_blocks(selected: DataFrame) -> DataFrame:
    """Per topic the numbered core lines, then the numbered periphery lines.

    A topic has at most core + periphery lines.
    """
    core = F.col("part") == "core"
    line = F.concat(
        F.when(core, F.lit("Chamado N")).otherwise(F.lit("Chamado P")),
        F.col("number").cast("string"),
        F.lit(": "),
        F.col("text"),
    )
    entry = F.struct("number", line.alias("line"))

    def lines(part):
        ordered = F.array_sort(F.collect_list(F.when(part, entry)))
        return F.transform(ordered, lambda e: e["line"])

    heading = F.lit(f"\n{names.PERIPHERY_HEADING}")
    return (
        selected.groupBy(*TOPIC)
        .agg(lines(core).alias("core"), lines(~core).alias("periphery"))
        .where(F.size("core") > 0)
        .select(
            *TOPIC,
            F.size("core").alias("n_core"),
            F.size("periphery").alias("n_periphery"),
            F.array_join(
                F.concat(
                    F.array(F.lit(names.CORE_HEADING)),
                    F.col("core"),
                    F.when(F.size("periphery") > 0, F.array(heading)).otherwise(
                        F.array().cast("array<string>")
                    ),
                    F.col("periphery"),
                ),
                "\n",
            ).alias("block"),
        )
    )


def summary_prompts(selected: DataFrame, terms: DataFrame) -> DataFrame:
    """User content per topic: keywords, then the tickets. Topics without a core have none."""
    words = first_keywords(terms, None)
    content = F.concat(
        F.lit("Keywords do tópico: "),
        text.quoted_keyword_string(F.col("terms")),
        F.lit("\n\n"),
        F.col("block"),
    )
    return (
        ticket_blocks(selected)
        .join(words, TOPIC, "left")
        .select(*TOPIC, "n_core", "n_periphery", content.alias("content"))
    )


def summary_jobs(
    tickets: DataFrame,
    assignments: DataFrame,
    distribution: DataFrame | None,
    terms: DataFrame,
    done: DataFrame,
) -> DataFrame:
    """Prompts of all topics still to be summarised."""
    todo = pending(assignments.select(*TOPIC).distinct(), done)
    open_assignments = assignments.join(stored(todo), TOPIC, "left_semi")
    return summary_prompts(select_tickets(tickets, open_assignments, distribution), terms)


def checked_summaries(responses: DataFrame) -> DataFrame:
    """Answers with their fields; a malformed one is kept and only marked.

    ``responses``: ``system, topic, response_text``.
    """
    answer = text.strip(F.coalesce("response_text", F.lit("")))
    return responses.select(
        *TOPIC,
        answer.alias("text"),
        answers.dominant_pattern(answer).alias("pattern"),
        answers.operational_impact(answer).alias("impact"),
        answers.has_both_labels(answer).alias("valid"),
    )


def title_prompts(summaries: DataFrame, titles: DataFrame) -> DataFrame:
    """User content per untitled topic: titles its system already uses, then the summary.

    ``summaries`` and ``titles``: ``system, topic, text``.
    """
    used = (
        titles.where(F.coalesce("text", F.lit("")) != "")
        .groupBy("system")
        .agg(F.array_sort(F.collect_list(F.struct("topic", "text"))).alias("used"))
        .select("system", F.transform("used", lambda t: F.concat(F.lit("- "), t["text"])).alias("used"))
    )
    forbidden = F.when(
        F.size("used") > 0,
        F.concat(F.lit(f"{names.USED_TITLES_HEADING}\n"), F.array_join("used", "\n"), F.lit("\n\n")),
    ).otherwise(F.lit(""))
    content = F.concat(forbidden, F.lit(f"{names.SUMMARY_HEADING}\n"), F.col("text"))
    return (
        pending(summaries.where(F.coalesce("text", F.lit("")) != ""), titles)
        .join(used, "system", "left")
        .select(*TOPIC, content.alias("content"))
    )


def cleaned_titles(responses: DataFrame) -> DataFrame:
    """Titles from raw answers: ``system, topic, response_text`` in, ``text`` out."""
    title = answers.clean_title(F.col("response_text"), F.col("topic"))
    return responses.select(*TOPIC, title.alias("text"))
