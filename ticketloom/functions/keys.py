"""Ids, system keys and topic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(value: Column) -> Column:
    """Ids that went through a float column lose their '.0'; blanks go."""
    text = value.cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"\.0$", ""), r"^\s+|\s+$", "")


def system_key(system: Column) -> Column:
    return F.upper(F.replace(system, F.lit(" "), F.lit("")))


def topic_uid(system: Column, topic: Column) -> Column:
    """Key of a topic over all systems, e.g. ``SIAPE_3``."""
    return F.concat(system_key(system), F.lit("_"), topic.cast("string"))


def default_title(title: Column, topic: Column) -> Column:
    return F.coalesce(title, F.concat(F.lit("Tópico "), topic.cast("string")))


def seeded_order(seed: int, key: Column) -> Column:
    """A fixed pseudo-random order that any engine with md5 reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
