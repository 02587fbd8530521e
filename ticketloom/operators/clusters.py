"""Evaluation of a labelling: centroids, inertia, silhouette."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import vectors
from ticketloom.operators.scale import stored

# The task functions travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 8_192
# Distances that a task holds at a time, whatever the size of its blocks.
GAPS_HELD = 250_000


def topic_centroids(labelled: DataFrame, by: tuple[str, ...] = ("system", "topic")) -> DataFrame:
    """Mean vector and size per topic; sums shrink on the map side."""
    vector = array_to_vector(vectors.doubles(F.col("embedding")))
    return (
        labelled.groupBy(*by)
        .agg(Summarizer.mean(vector).alias("mean"), F.count(F.lit(1)).alias("n_documents"))
        .select(*by, vector_to_array("mean").alias("centroid"), "n_documents")
    )


def inertia(labelled: DataFrame, by: str = "system") -> DataFrame:
    """Sum of squared distances to the own centroid, per system.

    Sum |x|^2 - n |mean|^2 per topic would need one pass only, but loses digits for
    tight topics far from the origin; the distance itself is summed instead.
    """
    centroids = stored(topic_centroids(labelled, (by, "topic")))
    return (
        labelled.join(centroids, [by, "topic"])
        .withColumn("gap", vectors.squared_distance(F.col("embedding"), F.col("centroid")))
        .groupBy(by)
        .agg(F.sum("gap").alias("wcss"), F.countDistinct("topic").alias("k"))
    )


def silhouette_sq(labelled: DataFrame, by: str = "system") -> DataFrame:
    """Mean squared-Euclidean silhouette per system, 0 for topics of one ticket.

    The mean squared distance of x to a topic with n vectors, sum Y and sum of
    squares Z is |x|^2 + Z/n - 2 x.Y/n, so a ticket needs the few topic sums of its
    system and never meets other tickets.
    """
    vector = vectors.doubles(F.col("embedding"))
    square = vectors.dot(F.col("embedding"), F.col("embedding"))
    sums = (
        labelled.groupBy(by, "topic")
        .agg(
            Summarizer.sum(array_to_vector(vector)).alias("total"),
            F.sum(square).alias("squares"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(by, F.struct("topic", vector_to_array("total").alias("total"), "squares", "n").alias("t"))
        .groupBy(by)
        .agg(F.collect_list("t").alias("topics"))
    )

    def mean_gap(t, own):
        count = F.when(own, t["n"] - 1).otherwise(t["n"])
        return (F.col("square") * t["n"] + t["squares"] - 2 * vectors.dot(F.col("embedding"), t["total"])) / count

    gaps = F.transform(
        "topics",
        lambda t: F.struct(
            (t["topic"] == F.col("topic")).alias("own"),
            F.when(
                (t["topic"] != F.col("topic")) | (t["n"] > 1), mean_gap(t, t["topic"] == F.col("topic"))
            ).alias("gap"),
        ),
    )
    a = F.filter("gaps", lambda g: g["own"])[0]["gap"]
    b = F.array_min(F.transform(F.filter("gaps", lambda g: ~g["own"]), lambda g: g["gap"]))
    score = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0))
        .when(F.greatest("a", "b") == 0, F.lit(0.0))
        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    )
    return (
        labelled.join(stored(sums), by)
        .withColumn("square", square)
        .withColumn("gaps", gaps)
        .select(by, a.alias("a"), b.alias("b"))
        .groupBy(by)
        .agg(F.avg(score).alias("silhouette"), F.count(F.lit(1)).alias("n_documents"))
    )


def _points(labelled: DataFrame, by: str) -> DataFrame:
    return labelled.where(F.col("embedding").isNotNull() & F.col("topic").isNotNull()).select(
        F.col(by).cast("string").alias("system"),
        F.col("id").cast("string").alias("id"),
        F.col("topic").cast("int").alias("topic"),
        vectors.doubles(F.col("embedding")).alias("vector"),
    )


def _measured(points: DataFrame, block_rows: int) -> DataFrame:
    """Points with the topics whose distances have to be summed for them, and how they are cut.

    The mean distance of x to a topic lies between the distance to the topic's mean and the
    root of the mean squared distance. A topic whose lower end is above the smallest upper end
    cannot be the nearest other one. The own topic is always measured.
    """
    vector = array_to_vector(F.col("vector"))
    sums = points.groupBy("system", "topic").agg(
        Summarizer.mean(vector).alias("mean"),
        F.avg(vectors.dot(F.col("vector"), F.col("vector"))).alias("square"),
        F.count(F.lit(1)).alias("n"),
    )
    entry = F.struct("topic", vector_to_array("mean").alias("mean"), "square", "n")
    by_system = stored(
        sums.groupBy("system").agg(
            F.collect_list(entry).alias("topics"), F.ceil(F.sum("n") / block_rows).cast("int").alias("n_own")
        )
    )
    square = vectors.dot(F.col("vector"), F.col("vector"))

    def ends(t):
        product = vectors.dot(F.col("vector"), t["mean"])
        inner = F.greatest(F.col("_square") - 2 * product + vectors.dot(t["mean"], t["mean"]), F.lit(0.0))
        outer = F.greatest(F.col("_square") - 2 * product + t["square"], F.lit(0.0))
        return F.struct(
            t["topic"].alias("topic"),
            (t["topic"] == F.col("topic")).alias("own"),
            F.ceil(t["n"] / block_rows).cast("int").alias("n_blocks"),
            F.sqrt(inner).alias("low"),
            F.sqrt(outer).alias("high"),
        )

    # What rounding can take off a difference of squares, and more.
    slack = 1e-6 * (1 + F.sqrt("_square"))
    near = F.array_min(F.transform(F.filter("_ends", lambda e: ~e["own"]), lambda e: e["high"]))
    wanted = F.filter("_ends", lambda e: e["own"] | (e["low"] <= F.col("_near") + F.col("_slack")))
    return (
        points.join(by_system, "system")
        .withColumn("_square", square)
        .withColumn("_ends", F.transform("topics", ends))
        .withColumns({"_near": near, "_slack": slack})
        .select(
            "system",
            "id",
            "topic",
            "vector",
            "n_own",
            F.size("topics").alias("n_topics"),
            F.transform(wanted, lambda e: F.struct(e["topic"].alias("topic"), e["n_blocks"].alias("n_blocks"))).alias("wanted"),
        )
    )


def silhouette_work(labelled: DataFrame, by: str = "system") -> DataFrame:
    """How many (ticket, topic) sums of distances are measured, and of how many: ``system, measured, pairs``."""
    return (
        _measured(_points(labelled, by), BLOCK_ROWS)
        .groupBy(F.col("system").alias(by))
        .agg(F.sum(F.size("wanted")).alias("measured"), F.sum("n_topics").cast("long").alias("pairs"))
    )


def silhouette_euclidean(labelled: DataFrame, by: str = "system", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean silhouette per system with plain distances.

    The definition needs the distances of a ticket to all tickets of its own and of the nearest
    other topic; topics that bounds show to be farther are not measured. Distances are summed
    inside Arrow tasks, a block of tickets against a block of a topic: a task gives out one row
    per ticket, never a pair. ``labelled`` has ``id, topic, embedding`` and the system; ids are
    unique within a system. Tickets without a topic or a vector do not count.
    """
    points = _points(labelled, by)
    placed = stored(_measured(points, block_rows))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        placed.select("system", "id", "topic", "vector", block("n_own").alias("i"), F.explode("wanted").alias("_w"))
        .select("system", "id", "topic", "vector", "i", F.col("_w.topic").alias("other"), F.col("_w.n_blocks").alias("n"))
        .select("system", "id", "topic", "vector", "i", "other", upto("n").alias("j"))
    )
    # New names for the other side: both sides are the same table.
    own = F.filter("wanted", lambda w: w["topic"] == F.col("topic"))[0]["n_blocks"]
    right = (
        placed.select(
            F.col("system").alias("system"), F.col("id").alias("id"), F.col("topic").alias("other"),
            F.col("vector").alias("vector"), "n_own", own.alias("n"),
        )
        .withColumn("j", block("n"))
        .select("system", "id", "other", "vector", "j", upto("n_own").alias("i"))
    )

    def measure(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return _GAPS.empty_table()
        return _gap_sums(ours, theirs)

    keys = ["system", "other", "i", "j"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        measure, "system string, id string, topic int, other int, total double, n long"
    )
    per_topic = partial.groupBy("system", "id", "topic", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    same = F.col("topic") == F.col("other")
    sides = per_topic.groupBy("system", "id").agg(
        F.max(F.when(same, mean)).alias("a"), F.min(F.when(~same, mean)).alias("b")
    )
    undefined = F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0)
    score = F.when(undefined, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return sides.groupBy(F.col("system").alias(by)).agg(
        F.avg(score).alias("silhouette"), F.count(F.lit(1)).alias("n_documents")
    )


_GAPS = pa.schema(
    [("system", pa.string()), ("id", pa.string()), ("topic", pa.int32()), ("other", pa.int32()),
     ("total", pa.float64()), ("n", pa.int64())]
)


def _gap_sums(ours: pa.Table, theirs: pa.Table) -> pa.Table:
    """Summed distances of our tickets to theirs, all of one topic; a ticket has none to itself."""
    a, b = (
        t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        for t in (ours, theirs)
    )
    places = {ticket: i for i, ticket in enumerate(theirs.column("id").to_pylist())}
    itself = np.array([places.get(ticket, -1) for ticket in ours.column("id").to_pylist()])
    total = np.zeros(len(a))
    step = max(1, GAPS_HELD // len(b))
    lengths = (b * b).sum(1)
    for start in range(0, len(a), step):
        part = a[start : start + step]
        squares = (part * part).sum(1)[:, None] + lengths[None, :]
        squares -= 2 * (part @ b.T)
        gaps = np.sqrt(np.maximum(squares, 0, out=squares), out=squares)
        held = np.flatnonzero(itself[start : start + step] >= 0)
        gaps[held, itself[start + held]] = 0
        total[start : start + step] = gaps.sum(1)
    counts = len(b) - (itself >= 0)
    columns = [ours.column(c).combine_chunks() for c in ("system", "id", "topic", "other")]
    return pa.Table.from_arrays([*columns, pa.array(total), pa.array(counts.astype(np.int64))], schema=_GAPS)
