"""Anonymising cleaner and the name list it drops."""

from __future__ import annotations

import sys
from collections.abc import Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.functions import text, wordlists
from ticketloom.operators.columns import quoted
from ticketloom.operators.scale import one_row_each, salted_join, stored

# The task functions travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names that fit into one in-memory set per task.
MAX_IN_SET = 50_000


def name_list(*sources: DataFrame, column: str = "name") -> DataFrame:
    """Deny list from raw name lists: duplicates out, normalised, rules applied."""
    raw = sources[0].select(column)
    for other in sources[1:]:
        raw = raw.unionByName(other.select(column))
    return (
        raw.distinct()
        .select(text.normalize_name(F.col(column)).alias(column))
        .where((F.col(column) != wordlists.NOT_A_NAME) & (F.length(column) > 2))
        .distinct()
    )


def load_names(lines: DataFrame, column: str = "name") -> DataFrame:
    """Names from lines of text: blank lines out, the rest normalised."""
    return (
        lines.where(text.strip(F.col(column)) != "")
        .select(text.normalize(text.strip(F.col(column))).alias(column))
        .distinct()
    )


def small_name_set(name_table: DataFrame, most: int = MAX_IN_SET, column: str = "name") -> list[str] | None:
    """Names as a Python list if a count finds at most ``most``, else None."""
    names = stored(name_table.select(column))
    return [r[0] for r in names.collect()] if names.count() <= most else None


def clean_column(
    df: DataFrame,
    column: str,
    name_table: DataFrame | None = None,
    *,
    id_col: str = "id",
    output: str | None = None,
    stopwords: Iterable[str] | None = None,
    max_in_set: int = MAX_IN_SET,
) -> DataFrame:
    """Cleaned, anonymised text in ``output``; NULL becomes ''.

    A name list of usual size is probed inside the row, without any shuffle. A list
    too long for that is joined instead (see :func:`_anti_join`). The texts are the same
    either way; ``id_col`` only spreads the rows of the join and may hold nulls or repeats.
    """
    return clean_columns(
        df, {column: output or column}, name_table, id_col=id_col, stopwords=stopwords, max_in_set=max_in_set
    )


def clean_columns(
    df: DataFrame,
    columns: dict[str, str],
    name_table: DataFrame | None = None,
    *,
    id_col: str = "id",
    stopwords: Iterable[str] | None = None,
    max_in_set: int = MAX_IN_SET,
) -> DataFrame:
    """:func:`clean_column` for several columns, the name list read once."""
    dropped = set(text.stopwords() if stopwords is None else stopwords)
    names = [] if name_table is None else small_name_set(name_table, max_in_set)
    if names is not None:
        dropped.update(names)
        return df.withColumns(
            {
                out: F.array_join(text.content_tokens(quoted(source), dropped), " ")
                for source, out in columns.items()
            }
        )
    for source, out in columns.items():
        kept = text.content_tokens(quoted(source), dropped)
        df = _anti_join(df, kept, name_table, id_col, out)
    return df


@F.pandas_udf(T.StringType())
def _without(tokens: pd.Series, found: pd.Series) -> pd.Series:
    """Tokens that are not in a second list, joined by spaces; a set, since long texts hold many names."""

    def kept(own, names):
        if own is None:
            return None
        names = () if names is None else frozenset(names)
        return " ".join(t for t in own if t is not None and t not in names)

    return pd.Series([kept(*row) for row in zip(tokens, found)], dtype=object)


def _anti_join(
    df: DataFrame, tokens: Column, name_table: DataFrame, id_col: str, output: str
) -> DataFrame:
    """Token-level anti-join with a name list of any length.

    Each text sends its distinct tokens once; what is found in the list goes back to
    the text as an array and is taken out in place, so order and repeats of the kept
    tokens never leave the row. Tokens that occur in very many texts are sliced. Rows
    meet what was found by a digest of id and tokens, which no missing or repeated id
    can make null or ambiguous: what is found depends on the tokens alone. Tokens and names
    are stored, since the words, their counts and the texts are read from them in turn.
    """
    key = F.sha2(F.concat_ws("\n", F.col(id_col).cast("string"), F.array_join("_tokens", " ")), 256)
    rows = stored(df.withColumn("_tokens", tokens).withColumn("_row", F.unhex(key)))
    pairs = one_row_each(
        rows.select(F.col("_row").alias("_id"), F.array_distinct("_tokens").alias("_words")),
        "_words",
        "name",
    )
    listed = stored(
        pairs.groupBy("name")
        .agg(F.count(F.lit(1)).alias("_texts"))
        .join(name_table.select("name"), "name", "left_semi")
    )
    # Rows that are alike in id and tokens share a digest; their names are gathered once.
    found = (
        salted_join(pairs, listed, ["name"], "_texts", ["_id"])
        .groupBy("_id")
        .agg(F.collect_set("name").alias("_found"))
    )
    joined = rows.join(found, F.col("_row") == F.col("_id"), "left")
    return joined.withColumn(output, _without("_tokens", "_found")).drop("_id", "_row", "_tokens", "_found")
