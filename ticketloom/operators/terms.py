"""Class-based TF-IDF: what words set a topic apart (Grootendorst 2022)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions.text import words
from ticketloom.operators.scale import one_row_each, stored, top_per_group


def term_weights(documents: DataFrame, text: str = "text") -> DataFrame:
    """Weight of every word in every topic: ``system, topic, term, tf, f, weight``.

    weight = tf / words of the topic * ln(1 + A / f) with f the word's count over all
    topics of the system and A the (whole) mean number of words per topic. The one
    shuffle that sees single words is the count, which shrinks on the map side first;
    the sums over topics and words run on the counted table.
    """
    # The texts are read and cut into words once; all else works on the stored counts.
    known = documents.where(F.col("system").isNotNull() & F.col("topic").isNotNull())
    counted = stored(
        one_row_each(known.select("system", "topic", words(F.col(text)).alias("words")), "words", "term")
        .groupBy("system", "topic", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    sizes = counted.groupBy("system", "topic").agg(F.sum("tf").alias("topic_words"))
    means = sizes.groupBy("system").agg(
        F.floor(F.avg("topic_words")).cast("double").alias("mean_words")
    )
    # One row per topic, whatever the corpus.
    scale = stored(sizes.join(means, "system"))
    over_topics = Window.partitionBy("system", "term")
    weighted = counted.withColumn("f", F.sum("tf").over(over_topics)).join(
        scale, ["system", "topic"]
    )
    weight = F.col("tf") / F.col("topic_words") * F.log1p(F.col("mean_words") / F.col("f"))
    return weighted.select("system", "topic", "term", "tf", "f", weight.alias("weight"))


def topic_terms(weights: DataFrame, n: int = names.TOP_TERMS) -> DataFrame:
    """First n terms per topic, ranked from 1; equal weights in word order."""
    rounded = weights.select("system", "topic", "term", F.round("weight", 8).alias("score"))
    order = [F.col("score").desc(), F.col("term")]
    return top_per_group(rounded, ["system", "topic"], order, n)


def first_keywords(terms: DataFrame, n: int | None = names.TABLE_KEYWORDS) -> DataFrame:
    """Keyword list per topic: the first n terms, then empty ones dropped."""
    cut = terms if n is None else terms.where(F.col("rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return (
        cut.where(F.col("term") != "")
        .groupBy("system", "topic")
        .agg(F.transform(ordered, lambda t: t["term"]).alias("terms"))
    )


def topic_info(assignments: DataFrame, terms: DataFrame) -> DataFrame:
    """Topic, size and representation words."""
    from ticketloom.operators.counts import tickets_per_topic

    return tickets_per_topic(assignments).join(
        first_keywords(terms, None), ["system", "topic"], "left"
    )
