"""Which tickets of a topic are shown to the language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions.keys import seeded_order
from ticketloom.operators.scale import stored, top_per_group

TOPIC = ["system", "topic"]


def core_tickets(probabilities: DataFrame, size: int = names.CORE_SIZE) -> DataFrame:
    """Tickets with the highest probability in their topic.

    ``probabilities`` has ``system, topic, id, prob``, one row per ticket and its
    topic.
    """
    return top_per_group(probabilities, TOPIC, [F.col("prob").desc(), F.col("id")], size)


def periphery_tickets(
    probabilities: DataFrame,
    core_size: int = names.CORE_SIZE,
    size: int = names.PERIPHERY_SIZE,
    seed: int = names.SEED,
    core: DataFrame | None = None,
) -> DataFrame:
    """A seeded draw from the tickets outside the core.

    The draw takes the lowest hash keys. Among the ``core_size + size`` lowest keys of
    a topic at most ``core_size`` belong to the core, so the ``size`` lowest of the rest
    are among them: neither step has to order a whole topic.
    """
    core = core_tickets(probabilities, core_size) if core is None else core
    core = core.select(*TOPIC, "id")
    keyed = probabilities.select(*TOPIC, "id", seeded_order(seed, F.col("id")).alias("draw"))
    order = [F.col("draw"), F.col("id")]
    lowest = top_per_group(keyed, TOPIC, order, core_size + size, "_place").drop("_place")
    rest = lowest.join(core, [*TOPIC, "id"], "left_anti")
    return top_per_group(rest, TOPIC, order, size).drop("draw")


def fallback_tickets(
    tickets: DataFrame,
    core_size: int = names.CORE_SIZE,
    size: int = names.PERIPHERY_SIZE,
    seed: int = names.SEED,
) -> DataFrame:
    """Core and periphery by a seeded order alone, where no probabilities exist."""
    keyed = tickets.withColumn("_draw", seeded_order(seed, F.col("id")))
    order = [F.col("_draw"), F.col("id")]
    ranked = top_per_group(keyed, TOPIC, order, core_size + size).drop("_draw")
    part = F.when(F.col("rank") <= core_size, F.lit("core")).otherwise(F.lit("periphery"))
    return ranked.withColumn("part", part)


def select_tickets(
    tickets: DataFrame, assignments: DataFrame, distribution: DataFrame | None
) -> DataFrame:
    """Texts chosen per topic: ``system, topic, part, number, id, text``.

    ``tickets`` has ``system, id, position, text``; ``assignments`` has ``system, id,
    topic``; ``distribution`` has ``system, id, topic, prob``. Systems that have a
    distribution are ranked by it and lose missing texts after the choice; the others
    draw among tickets that have a text. Numbers follow the source order where tickets
    are ranked and the order of the draw where they are drawn.
    """
    texts = tickets.select("system", "id", "position", "text")
    no_place = F.lit(None).cast("long").alias("_place")
    if distribution is None:
        unranked = assignments
        ranked_choice = None
    else:
        ranked_systems = stored(distribution.select("system").distinct())
        own = assignments.join(ranked_systems, "system", "left_semi").join(
            distribution.select("system", "id", "topic", "prob"), ["system", "id", "topic"], "left"
        )
        # Ranked from one stored table of narrow rows: the core, and the draw outside it.
        probabilities = stored(own.select(*TOPIC, "id", F.coalesce("prob", F.lit(0.0)).alias("prob")))
        core = stored(core_tickets(probabilities).select(*TOPIC, "id", F.lit("core").alias("part")))
        periphery = periphery_tickets(probabilities, core=core).select(*TOPIC, "id", F.lit("periphery").alias("part"))
        ranked_choice = core.unionByName(periphery).select("*", no_place)
        unranked = assignments.join(ranked_systems, "system", "left_anti")
    drawn = fallback_tickets(
        unranked.join(texts.where(F.col("text").isNotNull()).select("system", "id", "position"), ["system", "id"]).select(
            *TOPIC, "id", "position"
        )
    )
    chosen_ids = drawn.select(*TOPIC, "id", "part", F.col("rank").cast("long").alias("_place"))
    if ranked_choice is not None:
        chosen_ids = ranked_choice.unionByName(chosen_ids)
    # At most core + periphery rows per topic, stored, and one join to the texts for all of them.
    chosen = texts.join(stored(chosen_ids), ["system", "id"]).where(F.col("text").isNotNull())
    chosen = chosen.withColumn("_place", F.coalesce("_place", F.col("position").cast("long")))
    numbered = Window.partitionBy(*TOPIC, "part").orderBy("_place", "id")
    return chosen.withColumn("number", F.row_number().over(numbered)).select(
        *TOPIC, "part", "number", "id", "text"
    )
