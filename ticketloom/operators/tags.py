"""Topic tags of tickets: several topics per ticket, kept as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions import keys
from ticketloom.operators.scale import stored, top_per_group


def first_seen_tags(assignments: DataFrame) -> DataFrame:
    """Per id: its topic keys and systems, distinct, in first-seen order.

    ``assignments`` has ``id, system, topic, system_order, position``. The order of a
    tag is its smallest (system order, position); it is found by an aggregation that
    shrinks on the map side, so the final list per id is as long as it has tags.
    """
    seen = F.min(F.struct("system_order", "position"))
    tags = (
        assignments.withColumn("id", keys.clean_id(F.col("id")))
        .groupBy("id", "system", "topic")
        .agg(seen.alias("seen"))
    )
    ordered = tags.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("seen", "system", "topic"))).alias("tags")
    )
    uids = F.transform("tags", lambda t: keys.topic_uid(t["system"], t["topic"]))
    systems = F.transform("tags", lambda t: t["system"])
    return ordered.select(
        "id",
        F.array_distinct(F.filter(uids, lambda u: u.isNotNull())).alias("topic_uids"),
        F.array_distinct(F.filter(systems, lambda s: s.isNotNull())).alias("systems"),
    )


def tag_string(tags: Column) -> Column:
    """Tags at the edge: one comma-joined string."""
    return F.array_join(tags, ",")


def tag_list(tags: Column) -> Column:
    """Tags from the string form; no tags for NULL and the unclassified marker."""
    classified = tags.isNotNull() & (tags != names.UNCLASSIFIED)
    return F.when(classified, F.transform(F.split(tags, ","), lambda t: F.trim(t))).otherwise(
        F.array().cast("array<string>")
    )


def first_per_id(tickets: DataFrame, position: str, id_col: str = "id") -> DataFrame:
    """First row of every id in source order, ids repaired before.

    The first place of an id is an aggregate of two narrow columns; whole rows move once, and
    only those at a first place, so an id with very many rows meets in no task. Places are
    unique; of rows that share the first one, any counts.
    """
    cleaned = tickets.withColumn(id_col, keys.clean_id(F.col(id_col)))
    first = cleaned.groupBy(F.col(id_col).alias("_id")).agg(F.min(position).alias("_place"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(position).eqNullSafe(F.col("_place"))
    return cleaned.join(first, same, "left_semi").dropDuplicates([id_col])


def tickets_with_tags(tickets: DataFrame, tags: DataFrame) -> DataFrame:
    """Every ticket with its tags; only the system of an untagged one is filled."""
    return tickets.join(tags, "id", "left").withColumn(
        "systems",
        F.coalesce("systems", F.array(F.lit(names.UNCLASSIFIED))),
    )


def postings(tickets: DataFrame) -> DataFrame:
    """Inverted index: one row per (topic key, ticket)."""
    return tickets.select(
        F.explode("topic_uids").alias("topic_uid"), "id"
    ).where(F.col("topic_uid") != "")


def with_valid_tag(tickets: DataFrame, topics: DataFrame) -> DataFrame:
    """Tickets marked by whether at least one of their raw tags is a known topic.

    Tag strings repeat a lot: the distinct ones are judged by a join and stored, and the
    verdict is looked up, by the join that their number asks for.
    """
    tagged = F.col("topic_tags").isNotNull() & (F.col("topic_tags") != names.UNCLASSIFIED)
    strings = tickets.where(tagged).select("topic_tags").distinct()
    pieces = strings.withColumn("topic_uid", F.explode(F.split("topic_tags", ",")))
    valid = stored(
        pieces.join(topics.select("topic_uid"), "topic_uid", "left_semi")
        .select("topic_tags")
        .distinct()
        .withColumn("valid", F.lit(True))
    )
    return tickets.join(valid, "topic_tags", "left").select(
        *tickets.columns, F.coalesce("valid", F.lit(False)).alias("valid")
    )


def mapped_counts(marked: DataFrame) -> DataFrame:
    """Tickets with a valid topic against all tickets."""
    return marked.agg(
        F.count_if("valid").alias("mapped"), F.count(F.lit(1)).alias("total")
    )
