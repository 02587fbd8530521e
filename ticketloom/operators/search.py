"""Two-level ticket search for a whole table of queries at once.

Inputs, all as DataFrames:

* queries: ``query_id, embedding`` and optionally ``system_filter, team_filter``;
* topics: ``topic_uid, system, embedding``, one row per topic;
* tickets: ``id, topic_uids`` (array), ``embedding``;
* details: ``id`` and the attributes to report, looked up for the few tickets found; the
  tickets table itself if not given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.operators.columns import same_system, team_contains
from ticketloom.operators.nearest import DECIMALS, top_matches
from ticketloom.operators.scale import stored


def _wanted(queries: DataFrame, column: str) -> Column:
    """A filter column of the queries, NULL when they have none or it is blank."""
    if column not in queries.columns:
        return F.lit(None).cast("string")
    return F.nullif(F.col(column), F.lit(""))


def _system_wanted(queries: DataFrame) -> Column:
    return F.nullif(_wanted(queries, "system_filter"), F.lit(names.ALL_SYSTEMS))


def falling(score: str) -> Column:
    """The order of scores: those that agree to six decimals are ties; rules compare them whole."""
    return F.round(score, DECIMALS).desc()


def _rank(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*order))


def rank_topics(queries: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """k best topics per query: ``query_id, topic_uid, system, topic_score, rank``."""
    best = top_matches(queries, topics, k, item_id="topic_uid")
    return best.join(topics.select("topic_uid", "system"), "topic_uid").select(
        "query_id", "topic_uid", "system", F.col("score").alias("topic_score"), "rank"
    )


def relevant_topics(queries: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """First k topics per query, those of the wanted system where a query has one.

    Such a query looks at ``k * WIDENING`` topics, drops those of other systems and
    only then cuts to k: the order of these steps decides the result.
    """
    wanted = queries.select("query_id", _system_wanted(queries).alias("_wanted"))
    filtered = "system_filter" in queries.columns
    ranked = rank_topics(queries, topics, k * names.WIDENING if filtered else k)
    if not filtered:
        return ranked
    kept = (
        ranked.join(wanted, "query_id")
        .where(F.col("_wanted").isNotNull() | (F.col("rank") <= k))
        .where(same_system(F.col("system"), F.col("_wanted")))
    )
    order = [F.col("rank")]
    return kept.withColumn("rank", _rank(order)).where(F.col("rank") <= k).drop("_wanted")


def specific_first(
    ranked: DataFrame,
    generic_system: str = names.GENERIC_SYSTEM,
    margin: float = names.GENERIC_MARGIN,
) -> DataFrame:
    """Generic topics stay only if they beat the best specific one by more than ``margin``.

    A query whose topics are all generic, or all specific, keeps them.
    """
    generic = F.col("system") == generic_system
    best = F.max(F.when(~generic, F.col("topic_score"))).over(Window.partitionBy("query_id"))
    return (
        ranked.withColumn("_best", best)
        .where(~generic | F.col("_best").isNull() | (F.col("topic_score") > F.col("_best") + margin))
        .drop("_best")
    )


def chosen_topics(
    queries: DataFrame,
    topics: DataFrame,
    k: int = 3,
    floor: float = names.TOPIC_FLOOR,
    generic_system: str = names.GENERIC_SYSTEM,
) -> DataFrame:
    """Topics a query searches in: ranked, filtered, above the floor, specific first."""
    above = relevant_topics(queries, topics, k).where(F.col("topic_score") >= floor)
    if "system_filter" not in queries.columns:
        return specific_first(above, generic_system)
    wanted = queries.select("query_id", _system_wanted(queries).alias("_wanted"))
    marked = above.join(wanted, "query_id")
    # The rule is a window per query, so the two kinds of queries do not mix.
    free = specific_first(marked.where(F.col("_wanted").isNull()), generic_system)
    return free.unionByName(marked.where(F.col("_wanted").isNotNull())).drop("_wanted")


def detected_system(
    queries: DataFrame,
    chosen: DataFrame,
    tickets: DataFrame,
    generic_system: str = names.GENERIC_SYSTEM,
) -> DataFrame:
    """System a query is about and the number of tickets it searched.

    The system is that of the best topic; that of the first one, specific before
    generic, if the topics hold no ticket; the wanted one if no topic was left. Tickets
    are counted through their distinct tag lists, of which there are few, so no (query,
    ticket) pair is ever formed.
    """
    best = F.min_by("system", "rank")
    first = F.min_by("system", F.struct(F.col("system") == generic_system, "rank"))
    systems = chosen.groupBy("query_id").agg(best.alias("_best"), first.alias("_first"))
    tag_lists = tickets.groupBy("topic_uids").agg(F.count(F.lit(1)).alias("n"))
    reached = tag_lists.select(
        "topic_uids", "n", F.explode(F.array_distinct("topic_uids")).alias("topic_uid")
    ).join(chosen.select("query_id", "topic_uid"), "topic_uid")
    searched = (
        reached.select("query_id", "topic_uids", "n")
        .distinct()
        .groupBy("query_id")
        .agg(F.sum("n").alias("n_candidates"))
    )
    found = F.when(F.col("n_candidates").isNull(), F.col("_first")).otherwise(F.col("_best"))
    return (
        queries.select("query_id", _wanted(queries, "system_filter").alias("_wanted"))
        .join(systems, "query_id", "left")
        .join(searched, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(found, "_wanted").alias("detected_system"),
            F.coalesce("n_candidates", F.lit(0).cast("bigint")).alias("n_candidates"),
        )
    )


def tickets_in_topics(
    queries: DataFrame, chosen: DataFrame, tickets: DataFrame, k: int, floor: float = float("-inf")
) -> DataFrame:
    """k best tickets per query among those of its topics: ``query_id, id, score, rank``.

    Tickets below ``floor`` need not be found.
    """
    groups = chosen.groupBy("query_id").agg(F.collect_set("topic_uid").alias("groups"))
    asking = queries.select("query_id", "embedding").join(groups, "query_id")
    offered = tickets.select("id", "embedding", F.col("topic_uids").alias("groups"))
    return top_matches(asking, offered, k, item_id="id", grouped=True, floor=floor)


def hierarchical_search(
    queries: DataFrame,
    topics: DataFrame,
    tickets: DataFrame,
    k_topics: int = 3,
    k_tickets: int = 5,
    topic_floor: float = names.TOPIC_FLOOR,
    floor: float = float("-inf"),
) -> DataFrame:
    """Best tickets per query, searched only in the query's best topics; those below ``floor`` need not be found."""
    chosen = chosen_topics(queries, topics, k_topics, topic_floor)
    return tickets_in_topics(queries, chosen, tickets, k_tickets, floor)


def with_attributes(matches: DataFrame, details: DataFrame, *columns: str) -> DataFrame:
    """Ticket attributes next to the matches.

    Matches are few: their ids go ahead into the details, so that what these are made of is
    looked up or summed for those tickets alone.
    """
    found = stored(matches.select("id").distinct())
    return matches.join(details.join(found, "id", "left_semi").select("id", *columns), "id")


def similar_tickets(
    queries: DataFrame,
    topics: DataFrame,
    tickets: DataFrame,
    k: int = 10,
    floor: float = names.SUPPORT_FLOOR,
    k_topics: int = 5,
    topic_floor: float = names.SUPPORT_FLOOR,
    attributes: tuple[str, ...] = ("team",),
    details: DataFrame | None = None,
) -> DataFrame:
    """Similar tickets for support: score floor, team filter, then the cut to k.

    A query with a team filter fetches ``OVERFETCH`` times as many tickets first; it may
    still end up with fewer than k.
    """
    with_team = "team_filter" in queries.columns
    # Stored, because several results are read from the matches, and because Spark then
    # knows how few they are when it looks up their tickets.
    fetched = stored(
        hierarchical_search(
            queries, topics, tickets, k_topics, k * names.OVERFETCH if with_team else k, topic_floor, floor
        )
    )
    columns = tuple(dict.fromkeys(("team", *attributes)))
    source = tickets if details is None else details
    rows = with_attributes(fetched.where(F.col("score") >= floor), source, *columns)
    if with_team:
        wanted = queries.select("query_id", _wanted(queries, "team_filter").alias("_team"))
        rows = (
            rows.join(wanted, "query_id")
            .where(F.col("_team").isNotNull() | (F.col("rank") <= k))
            .where(team_contains(F.col("team"), F.col("_team")))
            .drop("_team")
        )
    order = [falling("score"), F.col("id")]
    return (
        rows.withColumn("rank", _rank(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score", *columns)
    )


def tickets_as_queries(ids: DataFrame, tickets: DataFrame) -> DataFrame:
    """Queries from ticket ids: the vector of the first ticket with that id.

    ``tickets`` has a unique ``id``. The ticket itself stays findable.
    """
    wanted = ids.select(F.trim(F.col("id").cast("string")).alias("id")).distinct()
    return wanted.join(tickets.select("id", "embedding"), "id").select(
        F.col("id").alias("query_id"), "embedding"
    )


def result_pattern(results: DataFrame) -> DataFrame:
    """What the tickets found for a query have in common.

    ``results`` has ``query_id, id, team, category, hours, score``. At most k rows per
    query reach this point.
    """
    def most_frequent(column: str) -> DataFrame:
        value = F.coalesce(F.col(column), F.lit("N/A"))
        counted = results.groupBy("query_id", value.alias(column)).agg(F.count(F.lit(1)).alias("_n"))
        first = Window.partitionBy("query_id").orderBy(F.col("_n").desc(), column)
        return counted.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")

    hours = F.col("hours").cast("double")
    valid = F.when(~F.isnan(hours) & (hours > 0), hours)
    figures = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_tickets"),
        F.coalesce(F.avg(valid), F.lit(0.0)).alias("mean_hours"),
        F.avg("score").alias("mean_score"),
    )
    teams = most_frequent("team").select(
        "query_id", F.col("team").alias("modal_team"), F.col("_n").alias("modal_team_n")
    )
    categories = most_frequent("category").select("query_id", F.col("category").alias("modal_category"))
    return (
        figures.join(teams, "query_id")
        .join(categories, "query_id")
        .withColumn("concentrated", F.col("modal_team_n") >= F.col("n_tickets") * names.CONCENTRATION)
    )


def confidence(best_score: Column, found: Column) -> Column:
    """Confidence tier of the best score."""
    return (
        F.when(~found, F.lit("Nenhuma"))
        .when(best_score >= names.HIGH_SCORE, F.lit("Alta"))
        .when(best_score >= names.MEDIUM_SCORE, F.lit("Média"))
        .otherwise(F.lit("Baixa"))
    )


def recommend(
    queries: DataFrame,
    topics: DataFrame,
    tickets: DataFrame,
    k: int = 3,
    details: DataFrame | None = None,
    **options,
) -> DataFrame:
    """One row per query: tier, best score, tickets in rank order and their pattern."""
    # Stored: the lists and every part of the pattern read the few rows found, not the tickets again.
    results = stored(
        similar_tickets(
            queries, topics, tickets, k, attributes=("team", "category", "hours"), details=details, **options
        )
    )
    lists = results.groupBy("query_id").agg(
        F.max("score").alias("best_score"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda t: t["id"]
        ).alias("tickets"),
    )
    answered = lists.join(result_pattern(results), "query_id")
    best = F.coalesce("best_score", F.lit(0.0))
    found = F.col("best_score").isNotNull()
    return queries.select("query_id").join(answered, "query_id", "left").select(
        "query_id",
        confidence(best, found).alias("confidence"),
        best.alias("best_score"),
        F.coalesce("tickets", F.array().cast("array<string>")).alias("tickets"),
        "modal_team",
        "modal_team_n",
        F.coalesce("n_tickets", F.lit(0).cast("bigint")).alias("n_tickets"),
        "modal_category",
        "mean_hours",
        "mean_score",
        "concentrated",
    )
