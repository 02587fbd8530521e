"""Reading the texts a language model returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions.text import strip

# The two labels every summary carries.
_PATTERN_FIELD = r"(?s)\*\*Padrão Dominante\*\*:\s*(.*?)(?=\*\*Impacto Operacional\*\*|$)"
_IMPACT_FIELD = r"(?s)\*\*Impacto Operacional\*\*:\s*(.*)"


def _field(text: Column, pattern: str) -> Column:
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1))


def dominant_pattern(summary: Column) -> Column:
    """Field behind the first label; '' when missing."""
    return _field(summary, _PATTERN_FIELD)


def operational_impact(summary: Column) -> Column:
    """Field behind the second label; '' when missing."""
    return _field(summary, _IMPACT_FIELD)


def has_both_labels(summary: Column) -> Column:
    text = F.coalesce(summary, F.lit(""))
    return text.contains(names.PATTERN_LABEL) & text.contains(names.IMPACT_LABEL)


def clean_title(answer: Column, topic: Column) -> Column:
    """Quotes and stray numbering off; an empty title becomes the placeholder."""
    title = strip(F.coalesce(answer, F.lit("")))
    title = F.regexp_replace(title, r'^"+|"+$', "")
    title = F.regexp_replace(title, r"^'+|'+$", "")
    numbered = strip(F.regexp_replace(title, r"^[0-9. ]+", ""))
    title = F.when(title.rlike(r"^[0-9]"), numbered).otherwise(title)
    return F.when(
        title == "", F.concat(F.lit("Tópico "), topic.cast("string"))
    ).otherwise(title)
