"""Counts, series, indicators and layouts of the topic tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.functions import keys, times
from ticketloom.operators.columns import quoted
from ticketloom.operators.scale import stored


def tickets_per_topic(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("system", "topic").agg(F.count(F.lit(1)).alias("n_documents"))


def large_enough(df: DataFrame, minimum: int, by: str = "system") -> DataFrame:
    """Rows of the groups with at least ``minimum`` rows.

    The groups that pass are found by an aggregation and kept by a semi-join: a
    window count would bring every row of a system into one task.
    """
    passing = df.groupBy(by).count().where(F.col("count") >= minimum).select(by)
    return df.join(stored(passing), by, "left_semi")


def topic_spine(systems: DataFrame) -> DataFrame:
    """Every topic 0..k-1 of every system, from a table ``system, k``."""
    return systems.where("k > 0").select(
        "system", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("topic")
    )


def counts_on_spine(spine: DataFrame, assignments: DataFrame) -> DataFrame:
    """Document count of every topic of the spine, 0 where there is none."""
    return spine.join(tickets_per_topic(assignments), ["system", "topic"], "left").withColumn(
        "n_documents", F.coalesce("n_documents", F.lit(0).cast("bigint"))
    )


def refreshed_counts(coordinates: DataFrame, assignments: DataFrame) -> DataFrame:
    """Coordinates with the newest counts; the stored count where there is none."""
    fresh = tickets_per_topic(assignments).withColumnRenamed("n_documents", "_fresh")
    stored = F.col("n_documents") if "n_documents" in coordinates.columns else F.lit(None)
    return (
        coordinates.where("topic >= 0")
        .join(fresh, ["system", "topic"], "left")
        .withColumn("n_documents", F.coalesce("_fresh", stored.cast("bigint"), F.lit(0).cast("bigint")))
        .drop("_fresh")
    )


def dated_assignments(tickets: DataFrame, assignments: DataFrame) -> DataFrame:
    """Ticket dates with the topic of the ticket; tickets without a date go first."""
    dated = tickets.where(F.col("opened").isNotNull()).select("system", "id", "opened")
    return dated.join(assignments.select("system", "id", "topic"), ["system", "id"])


def monthly_evolution(
    dated: DataFrame, titles: DataFrame, topics: Iterable[int] | None = None
) -> DataFrame:
    """Tickets per month and topic with the topic's title."""
    if topics is not None:
        dated = dated.where(F.col("topic").isin(list(topics)))
    monthly = dated.groupBy("system", times.month_of(F.col("opened")).alias("month"), "topic").agg(
        F.count(F.lit(1)).alias("n_tickets")
    )
    titled = monthly.join(titles.select("system", "topic", "title"), ["system", "topic"], "left")
    return titled.select(
        "system",
        "month",
        "topic",
        keys.default_title(F.col("title"), F.col("topic")).alias("title"),
        "n_tickets",
    ).orderBy("system", "month", "topic")


def monthly_total(monthly: DataFrame) -> DataFrame:
    return (
        monthly.groupBy("system", "month")
        .agg(F.sum("n_tickets").alias("n_tickets"))
        .orderBy("system", "month")
    )


def monthly_rollup(dated: DataFrame) -> DataFrame:
    """Month totals (topic NULL) and month-topic counts.

    Tickets are counted once; the roll-up repeats rows per level and works on the counts.
    """
    month = times.month_of(F.col("opened"))
    monthly = dated.groupBy("system", month.alias("month"), "topic").count()
    return (
        monthly.rollup("system", "month", "topic")
        .agg(F.sum("count").alias("n_tickets"), F.grouping_id().alias("level"))
        .where("level < 2")
        .select("system", "month", "topic", "n_tickets")
    )


def indicators(topic_table: DataFrame) -> DataFrame:
    """Headline figures per system: topics, documents, mean size, largest topic."""
    largest = F.max_by(
        F.struct("title", "n_documents"), F.struct(F.col("n_documents"), -F.col("topic"))
    )
    return (
        topic_table.groupBy("system")
        .agg(
            F.count(F.lit(1)).alias("n_topics"),
            F.sum("n_documents").alias("n_documents"),
            largest.alias("largest"),
        )
        .select(
            "system",
            "n_topics",
            "n_documents",
            F.bround(F.col("n_documents") / F.col("n_topics"), 1).alias("mean_documents"),
            F.col("largest.title").alias("largest_title"),
            F.col("largest.n_documents").alias("largest_n"),
        )
    )


def ranking(topic_table: DataFrame, descending: bool = False) -> DataFrame:
    """Topics by volume, the five columns the table view shows."""
    volume = F.col("n_documents").desc() if descending else F.col("n_documents").asc()
    shown = ("system", "topic", "title", "n_documents", "pattern", "impact")
    return topic_table.select(*[c for c in shown if c in topic_table.columns]).orderBy(
        "system", volume, "topic"
    )


def team_frequency(tickets: DataFrame, team: str = "team") -> DataFrame:
    """Tickets per team, most frequent first; missing and blank teams do not count."""
    return (
        tickets.where(quoted(team).isNotNull() & (F.trim(quoted(team)) != ""))
        .groupBy(quoted(team).alias("team"))
        .agg(F.count(F.lit(1)).alias("n_tickets"))
        .orderBy(F.col("n_tickets").desc(), "team")
    )


def _over_system(value: Column, how) -> Column:
    return how(value).over(Window.partitionBy("system"))


def prevalence_scale(topic_table: DataFrame) -> DataFrame:
    """Square root of the size, stretched to [1, 10]; 5 if all sizes are equal.

    The window runs over topics, of which a system has a handful, not over tickets.
    """
    root = F.sqrt(F.greatest(F.col("n_documents"), F.lit(1)).cast("double"))
    low, high = _over_system(root, F.min), _over_system(root, F.max)
    scaled = F.when(high > low, 1 + (root - low) / (high - low) * 9).otherwise(F.lit(5.0))
    return topic_table.withColumn("size", scaled)


def circular_layout(topic_table: DataFrame) -> DataFrame:
    """Topics of a system evenly on a circle: the map without coordinates."""
    per_system = Window.partitionBy("system")
    place = F.row_number().over(per_system.orderBy("topic")) - 1
    angle = 2 * F.pi() * place / F.count(F.lit(1)).over(per_system)
    return topic_table.withColumns({"x": F.cos(angle), "y": F.sin(angle)})


def map_points(topic_table: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Points of the topic map; systems without coordinates lie on a circle."""
    placed = coordinates.select("system", "topic", "x", "y", "n_documents")
    missing = topic_table.join(placed.select("system").distinct(), "system", "left_anti")
    circle = circular_layout(missing).select("system", "topic", "x", "y", "n_documents")
    points = placed.unionByName(circle).join(
        topic_table.select("system", "topic", "title"), ["system", "topic"], "left"
    )
    return prevalence_scale(
        points.withColumn("title", keys.default_title(F.col("title"), F.col("topic")))
    )
