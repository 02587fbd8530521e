"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.storage import stored


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component) of every linked node, the component being its smallest node.

    Alternates the large-star and the small-star step until nothing changes. Neither step
    gathers the neighbours of a node in one place: minima are merged on the map side and a
    node with many links joins as any skewed key does. Every round is stored, so a lost
    executor costs one round at most.
    """
    edges = stored(
        links.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).where("u <> v").distinct(),
        "edges",
    )
    known = _state(edges)
    while known[0]:
        # Large star: every larger neighbour of a node is tied to the smallest one around it.
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = stored(small, "edges")
        now = _state(edges)
        if now == known:
            break
        known = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """A number that changes when the edges do."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
