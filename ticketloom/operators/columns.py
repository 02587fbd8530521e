"""Column resolution, null handling and simple filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom import names
from ticketloom.functions import keys
from ticketloom.functions.text import normalize_label


def quoted(name: str) -> Column:
    """Column by literal name: headers may hold dots."""
    return F.col(f"`{name}`")


def match_labels(columns: Sequence[str], labels: Iterable[str]) -> list[str]:
    """Columns whose accent-free lower-case name is one of the labels.

    Of two columns with the same normalised name the later one counts.
    """
    by_label = {normalize_label(c): c for c in columns}
    return [by_label[label] for label in labels if label in by_label]


def description_column(columns: Sequence[str]) -> str | None:
    """The description: first known header, else the first header that hints at it."""
    for candidate in names.DESCRIPTION_CANDIDATES:
        if candidate in columns:
            return candidate
    for column in columns:
        if any(hint in column.lower() for hint in names.DESCRIPTION_HINTS):
            return column
    return None


def id_column(columns: Sequence[str]) -> str:
    return "Id" if "Id" in columns else "id"


def topic_column(columns: Sequence[str]) -> str:
    return "dominant_topic" if "dominant_topic" in columns else columns[-1]


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_or_empty(df: DataFrame, required: Mapping[str, T.DataType]) -> DataFrame:
    """The table itself, or a typed empty one when a required column is missing."""
    if not missing_columns(df, required):
        return df
    schema = T.StructType([T.StructField(n, t) for n, t in required.items()])
    return df.sparkSession.createDataFrame([], schema)


def insert_after(df: DataFrame, anchor: str, name: str, value: Column) -> DataFrame:
    """A new column directly behind ``anchor``; at the end if there is no anchor."""
    order = [c for c in df.columns if c != name]
    at = order.index(anchor) + 1 if anchor in order else len(order)
    order.insert(at, name)
    return df.withColumn(name, value).select(*[quoted(c) for c in order])


def preferred_order(df: DataFrame, preferred: Iterable[str]) -> DataFrame:
    """Preferred columns that exist, then all others."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*[quoted(c) for c in [*first, *(c for c in df.columns if c not in first)]])


def add_if_missing(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, value)


def copy_if_missing(df: DataFrame, name: str, source: str) -> DataFrame:
    """Column ``name`` from ``source`` when only the latter exists."""
    if name in df.columns or source not in df.columns:
        return df
    return df.withColumn(name, quoted(source))


def fill_nulls(df: DataFrame, fills: Mapping[str, str]) -> DataFrame:
    return df.fillna({c: v for c, v in fills.items() if c in df.columns})


def ticket_by_id(tickets: DataFrame, wanted: str, position: str, id_col: str = "id") -> DataFrame:
    """The first ticket with this id, blanks around the id ignored."""
    hits = tickets.where(quoted(id_col).cast("string") == wanted.strip())
    return hits.orderBy(position).limit(1)


def same_system(system: Column, wanted: Column) -> Column:
    """System filter, any case; NULL and the all-systems key let everything pass."""
    return (
        wanted.isNull()
        | (wanted == "")
        | (wanted == names.ALL_SYSTEMS)
        | (F.upper(system) == F.upper(wanted))
    )


def team_contains(team: Column, wanted: Column) -> Column:
    """Team filter: any-case substring; no filter lets everything pass."""
    return (
        wanted.isNull()
        | (wanted == "")
        | F.upper(F.coalesce(team, F.lit(""))).contains(F.upper(wanted))
    )


def without_outliers(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.where(F.col(topic) >= 0)


def without_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(quoted(column)) != "")


def with_clean_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.withColumn(id_col, keys.clean_id(quoted(id_col)))
