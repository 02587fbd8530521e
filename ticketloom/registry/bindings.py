"""The driver tables in the roles of the ticket data model.

documents are the tickets (language = system, source = team), embeddings give vector
and topic of a ticket, orders and lineitem give its dates, customer its category, part
its title, benchmark the name list, pages the links, conversations the answer texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions import vectors
from ticketloom.operators import clusters, selection
from ticketloom.operators.scale import likely_matches, spread, stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tickets(spark: SparkSession, folder: str, text_work: bool = False) -> DataFrame:
    """``id, system, position, text, team`` of all documents, on all cores for text work."""
    documents = table(spark, folder, "documents")
    if text_work:
        documents = spread(documents, "doc_id")
    return documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("system"),
        F.col("doc_id").alias("position"),
        "text",
        F.col("source").alias("team"),
    )


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("label").alias("topic"), "embedding"
    )


def assigned(spark: SparkSession, folder: str, text_work: bool = False) -> DataFrame:
    """Tickets that have a vector, with vector and topic."""
    rows, known = tickets(spark, folder, text_work), labels(spark, folder)
    if text_work:
        rows = likely_matches(rows, known, "id")
    return rows.join(known, "id")


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """``system, id, topic`` without texts and vectors."""
    return assigned(spark, folder).select("system", "id", "topic")


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets with their opening date."""
    dates = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("opened")
    )
    return tickets(spark, folder).select("system", "id").join(dates, "id")


def systems(spark: SparkSession, folder: str) -> DataFrame:
    """``system, k``: two topics more than are in use, so that some are empty."""
    return assignments(spark, folder).groupBy("system").agg(
        (F.max("topic") + 3).cast("int").alias("k")
    )


def spine(spark: SparkSession, folder: str) -> DataFrame:
    from ticketloom.operators.counts import topic_spine

    return topic_spine(systems(spark, folder))


def titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of the first topics of every system; the others have none."""
    region = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("topic"), F.col("r_name").alias("text")
    )
    return spine(spark, folder).join(region, "topic").select("system", "topic", "text")


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """A two-field summary per topic."""
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("topic"), "n_name", F.col("n_regionkey").alias("r_regionkey")
    )
    region = table(spark, folder, "region")
    text = F.concat(
        F.lit(f"{names.PATTERN_LABEL}: "), "n_name", F.lit(f"\n{names.IMPACT_LABEL}: "), "r_name"
    )
    return (
        spine(spark, folder)
        .join(nation, "topic")
        .join(region, "r_regionkey")
        .select("system", "topic", text.alias("text"))
    )


def raw_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets with the headers of the raw base and a position."""
    documents = table(spark, folder, "documents")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    pages = table(spark, folder, "pages").select("page_id", "url")
    solved = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_shipdate").alias("solved"))
    )
    key = documents["doc_id"]
    return (
        documents.join(part, part["p_partkey"] == key, "left")
        .join(customer, customer["c_custkey"] == key, "left")
        .join(orders, orders["o_orderkey"] == key, "left")
        .join(solved, solved["l_orderkey"] == key, "left")
        .join(pages, pages["page_id"] == key, "left")
        .select(
            F.concat(F.col("doc_id").cast("string"), F.lit(".0")).alias(names.ID),
            F.col("p_name").alias(names.TITLE),
            F.col("text").alias(names.DESCRIPTION),
            F.concat(F.lit("ver "), "url", F.lit(" fim")).alias(names.SOLUTION),
            F.col("source").alias(names.TEAM),
            F.col("c_mktsegment").alias(names.CATEGORY),
            F.col("o_orderstatus").alias(names.STATUS),
            F.col("o_orderpriority").alias(names.PRIORITY),
            F.col("o_orderdate").alias(names.OPENED),
            F.col("solved").alias(names.SOLVED),
            F.col("n_chars").alias("extra"),
            F.col("doc_id").alias("position"),
        )
    )


def name_words(spark: SparkSession, folder: str) -> DataFrame:
    """Raw name list: the words of the benchmark passages."""
    return table(spark, folder, "benchmark").select(
        F.explode(F.split("text", r"\P{L}+")).alias("name")
    )


def own_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """``system, topic, id, prob``: cosine of a ticket to the centroid of its topic."""
    rows = assigned(spark, folder).select("system", "id", "topic", "embedding")
    centroids = clusters.topic_centroids(rows).select(
        "system", "topic", vectors.unit(F.col("centroid")).alias("centroid")
    )
    cosine = vectors.dot(F.col("embedding"), F.col("centroid"))
    return rows.join(stored(centroids), ["system", "topic"]).select(
        "system", "topic", "id", F.round(cosine, 6).alias("prob")
    )


def selected(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets chosen for the prompts: German and French systems have no probabilities."""
    ranked = own_cosine(spark, folder).where(F.col("system").isin("en", "es"))
    return selection.select_tickets(
        tickets(spark, folder), assignments(spark, folder), ranked
    )


def search_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of the search: the unit centroid of every (system, topic)."""
    centroids = clusters.topic_centroids(
        assigned(spark, folder).select("system", "topic", "embedding")
    )
    return centroids.select(
        F.concat(F.upper("system"), F.lit("_"), F.col("topic").cast("string")).alias("topic_uid"),
        "system",
        vectors.unit(F.col("centroid")).alias("embedding"),
    )


def search_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets of the search with two tags each.

    The second tag is the same topic number in another language system, as a ticket may
    be in its own system and in the one over all.
    """
    second = F.when(F.col("system") == "en", F.lit("FR")).otherwise(F.lit("EN"))
    tag = lambda s: F.concat(s, F.lit("_"), F.col("topic").cast("string"))
    return assigned(spark, folder).select(
        "id", "embedding", F.array(tag(F.upper("system")), tag(second)).alias("topic_uids")
    )


def search_details(spark: SparkSession, folder: str) -> DataFrame:
    """Team, category and hours of every ticket."""
    category = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("category")
    )
    solved = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("solved")
    )
    from ticketloom.functions.times import hours_between

    hours = (
        table(spark, folder, "orders")
        .join(solved, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("id"),
            hours_between(F.col("o_orderdate"), F.col("solved")).alias("hours"),
        )
    )
    teams = tickets(spark, folder).select("id", "team")
    return teams.join(category, "id", "left").join(hours, "id", "left")


def search_queries(spark: SparkSession, folder: str, filters: bool = False) -> DataFrame:
    """Every ticket vector as a query; with filters a third each asks for its own
    system, for all systems, or for nothing, and half of them for a team."""
    rows = spread(table(spark, folder, "embeddings"), "vec_id").select(
        F.col("vec_id").cast("string").alias("query_id"), "embedding", "label"
    )
    if not filters:
        return rows.drop("label")
    system = (
        F.when(F.col("label") % 3 == 1, F.lit("EN"))
        .when(F.col("label") % 3 == 2, F.lit("TOTAIS"))
    )
    team = F.when(F.col("label") % 2 == 1, F.lit("SRC1"))
    return rows.select(
        "query_id", "embedding", system.alias("system_filter"), team.alias("team_filter")
    )
