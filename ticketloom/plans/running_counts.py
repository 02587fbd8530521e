"""Monthly counts that are kept up batch by batch instead of counted anew.

A batch of tickets becomes one small row for each (system, topic, month): what it adds, and,
for tickets that moved to another topic, system or month, what it takes away where they were.
These rows are one run of a table, so a repeated batch changes nothing, and their sums are the
counts of all tickets however often and in whatever order batches came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import keys, times
from ticketloom.sources import runs

SCHEMA = "system string, topic int, month timestamp_ntz, n long"
CELL = ["system", "topic", "month"]


def changes(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Plus and minus rows of a batch; ``added`` and ``removed`` have ``system, topic, opened``.

    ``removed`` are the former rows of tickets that moved. Cells where both cancel have no row.
    """
    counted = lambda rows, sign: rows.groupBy(
        "system", F.col("topic").cast("int").alias("topic"), times.month_of(F.col("opened")).alias("month")
    ).agg((F.count(F.lit(1)) * sign).alias("n"))
    plus = counted(added.where(F.col("opened").isNotNull()), 1)
    if removed is not None:
        plus = plus.unionByName(counted(removed.where(F.col("opened").isNotNull()), -1))
    return plus.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def add_batch(path: str, run: str, added: DataFrame, removed: DataFrame | None = None) -> bool:
    """Counts a batch under its name; False if it is counted already."""
    return runs.append_once(changes(added, removed), path, run)


def current(spark: SparkSession, path: str) -> DataFrame:
    """``system, topic, month, n_tickets`` over all batches."""
    summed = runs.read_runs(spark, path, SCHEMA).groupBy(*CELL).agg(F.sum("n").alias("n_tickets"))
    return summed.where("n_tickets <> 0")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The sums of all batches as the first run of another table, for when there are very many."""
    runs.append_once(current(spark, path).withColumnRenamed("n_tickets", "n"), target, "compacted")


def evolution(counts: DataFrame, titles: DataFrame) -> DataFrame:
    """The series of ``counts.monthly_evolution`` from kept counts."""
    titled = counts.join(titles.select("system", "topic", "title"), ["system", "topic"], "left")
    title = keys.default_title(F.col("title"), F.col("topic")).alias("title")
    return titled.select("system", "month", "topic", title, "n_tickets").orderBy("system", "month", "topic")


def totals(counts: DataFrame) -> DataFrame:
    """Tickets by month, from kept counts."""
    return counts.groupBy("system", "month").agg(F.sum("n_tickets").alias("n_tickets")).orderBy("system", "month")


def topic_sizes(counts: DataFrame) -> DataFrame:
    """Dated tickets by topic, from kept counts."""
    return counts.groupBy("system", "topic").agg(F.sum("n_tickets").alias("n_documents"))
