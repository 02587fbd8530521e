"""From the raw ticket table to cleaned texts and time metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ticketloom import names
from ticketloom.functions import times
from ticketloom.operators import columns
from ticketloom.operators.cleaning import clean_columns
from ticketloom.sources.writers import write_stage


def clean_tickets(
    raw: DataFrame, name_table: DataFrame | None = None, id_col: str = names.ID
) -> DataFrame:
    """All known text columns cleaned and anonymised in place; other columns untouched."""
    found = columns.match_labels(raw.columns, names.CLEANED_LABELS)
    return clean_columns(raw, {c: c for c in found}, name_table, id_col=id_col)


def parse_dates(raw: DataFrame, pattern: str | None = None) -> DataFrame:
    """Both date columns as timestamps; text that is no date becomes NULL."""
    parsed = {}
    for column in (names.OPENED, names.SOLVED):
        if column in raw.columns and dict(raw.dtypes)[column] == "string":
            parsed[column] = times.parse_timestamp(columns.quoted(column), pattern)
    return raw.withColumns(parsed) if parsed else raw


def fill_categories(tickets: DataFrame) -> DataFrame:
    return columns.fill_nulls(tickets, names.NULL_FILLS)


def add_hours(tickets: DataFrame) -> DataFrame:
    """Hours to solve, right behind the date of the solution."""
    hours = times.hours_between(columns.quoted(names.OPENED), columns.quoted(names.SOLVED))
    return columns.insert_after(tickets, names.SOLVED, names.HOURS, hours)


def drop_unused(tickets: DataFrame) -> DataFrame:
    return tickets.drop(*names.DROPPED_COLUMNS)


def prepare_metrics(raw: DataFrame, pattern: str | None = None) -> DataFrame:
    """Parse, fill, measure, drop: row-wise throughout, no shuffle."""
    return (
        raw.transform(parse_dates, pattern)
        .transform(fill_categories)
        .transform(add_hours)
        .transform(drop_unused)
    )


def split_by_system(tickets: DataFrame, path: str) -> DataFrame:
    """The ticket table partitioned by system, which later stages prune by."""
    return write_stage(tickets, path)


def with_text(tickets: DataFrame, text: str) -> DataFrame:
    """Tickets that have a text, as strings, ids repaired."""
    return columns.with_clean_id(tickets, columns.id_column(tickets.columns)).where(
        columns.quoted(text).isNotNull()
    ).withColumn(text, columns.quoted(text).cast("string"))
