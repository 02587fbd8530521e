"""How much of each topic is in a ticket, from sliding windows of words."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.text import words
from ticketloom.functions.vectors import round4
from ticketloom.operators.scale import one_row_each, stored

# The task functions travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# At most so many words are common, the most frequent ones, so that any other word holds less than
# 1/COMMON_SHARES of all occurrences.
COMMON_SHARES = 250_000
# Topics a common word may occur in on average, if not all words above 1/COMMON_SHARES are to be common.
COMMON_TOPICS = 10
# Tickets whose words are numbered at a time, which bounds the memory of a task.
CODED_ROWS = 500


def term_directory(weights: DataFrame) -> DataFrame:
    """One row per word of a system: its idf, the topics it occurs in with its shares, its count.

    A share is idf * weight / norm of the topic, so that a window's cosine is a sum of shares
    over the window's norm. Topics are numbered from 0; outliers (-1) count for the idf only.
    """
    norms = weights.groupBy("system", "topic").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.sum("tf").alias("topic_words"),
    )
    scale = norms.groupBy("system").agg(F.floor(F.avg("topic_words")).cast("double").alias("mean_words"))
    idf = F.log1p(F.col("mean_words") / F.col("f"))
    share = F.when(F.col("topic") >= 0, F.struct("topic", (idf * F.col("weight") / F.col("norm")).alias("share")))
    return (
        weights.join(stored(norms.join(scale, "system")), ["system", "topic"])
        .groupBy("system", "term")
        .agg(F.max(idf).alias("idf"), F.collect_list(share).alias("held"), F.max("f").alias("f"))
        .select(
            "system", "term", "idf", "f",
            F.transform("held", lambda s: s["topic"].cast("int")).alias("topics"),
            F.transform("held", lambda s: s["share"]).alias("shares"),
        )
    )


def _least_count(directory: DataFrame) -> int | None:
    """The smallest count of a common word; None if no word is common.

    What comes to the driver is a row for each count that occurs, of which there are no more than
    the root of twice the occurrences.
    """
    counts = directory.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("topics")).alias("shares"))
    ordered = counts.toArrow().sort_by([("f", "descending")])
    f, n, shares = (ordered.column(c).to_numpy() for c in ("f", "n", "shares"))
    few = (np.cumsum(n) <= COMMON_SHARES) & (np.cumsum(shares) <= COMMON_SHARES * COMMON_TOPICS)
    common = f[few | (f * float(COMMON_SHARES) > np.sum(f * n))]
    return int(common[-1]) if len(common) else None


class _Common(NamedTuple):
    """Common words of one system: word i has the topics and shares from starts[i] to starts[i + 1]."""

    terms: pa.Array
    idf: np.ndarray
    starts: np.ndarray
    topics: np.ndarray
    shares: np.ndarray


def _by_system(words: pa.Table) -> dict[object, _Common]:
    """The directory of the common words by system, as flat arrays."""
    found = {}
    for system in pc.unique(words.column("system")).to_pylist():
        own = words.filter(pc.equal(words.column("system"), pa.scalar(system, words.schema.field("system").type)))
        lists = own.column("topics").combine_chunks()
        found[system] = _Common(
            own.column("term").combine_chunks(),
            own.column("idf").to_numpy(),
            np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))),
            lists.flatten().to_numpy(),
            own.column("shares").combine_chunks().flatten().to_numpy(),
        )
    return found


def _coded(batch: pa.RecordBatch, common: dict[object, _Common]) -> pa.RecordBatch:
    """Words as numbers: i is the system's common word i, -1 - j the ticket's other word j."""
    tokens = batch.column(3)
    n_words = pc.list_value_length(tokens).to_numpy()
    row = np.repeat(np.arange(batch.num_rows), n_words)
    encoded = tokens.flatten().dictionary_encode()
    word, kinds = encoded.indices.to_numpy(), encoded.dictionary
    codes = np.full(len(row), -1, np.int32)
    systems = batch.column(0).to_pylist()
    for system in set(systems) & common.keys():
        of = np.array([s == system for s in systems])[row]
        known = pc.index_in(kinds, value_set=common[system].terms.cast(kinds.type))
        codes[of] = known.fill_null(-1).to_numpy()[word[of]]
    other = np.flatnonzero(codes < 0)
    pairs, at = np.unique(row[other] * max(len(kinds), 1) + word[other], return_inverse=True)
    starts = np.searchsorted(pairs // max(len(kinds), 1), np.arange(batch.num_rows + 1))
    codes[other] = -1 - (at - starts[row[other]])
    rest = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), kinds.take(pa.array(pairs % max(len(kinds), 1))))
    ends = pa.array(np.concatenate(([0], np.cumsum(n_words))), pa.int32())
    columns = [*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(codes, pa.int32())), rest]
    return pa.RecordBatch.from_arrays(columns, names=["system", "id", "key", "codes", "rest"])


def _entries(
    codes: np.ndarray, found: pa.StructArray | None, common: _Common | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """A ticket's words by number, their idf, and their shares by topic; None if they are in no topic."""
    used, tokens = np.unique(codes, return_inverse=True)
    idf = np.zeros(len(used))
    rows, topics, shares = [], [], []

    def hold(at, starts, ends, of_topics, of_shares):
        n = ends - starts
        flat = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        rows.append(np.repeat(at, n)), topics.append(of_topics[flat]), shares.append(of_shares[flat])

    at = np.flatnonzero(used >= 0)
    if len(at):
        number = used[at]
        idf[at] = common.idf[number]
        hold(at, common.starts[number], common.starts[number + 1], common.topics, common.shares)
    if found is not None and len(found):
        at = np.flatnonzero(used < 0)
        place = np.full(len(at), -1)
        place[found.field("place").to_numpy()] = np.arange(len(found))
        number = place[-1 - used[at]]
        at, number = at[number >= 0], number[number >= 0]
        lists = found.field("topics")
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        idf[at] = found.field("idf").to_numpy()[number]
        if len(at):
            hold(at, starts[number], starts[number + 1], lists.flatten().to_numpy(), found.field("shares").flatten().to_numpy())
    if not sum(map(len, topics)):
        return None
    topic = np.concatenate(topics)
    table = np.zeros((len(used), topic.max() + 1))
    table[np.concatenate(rows), topic] = np.concatenate(shares)
    return tokens, idf, table


def _mass(tokens: np.ndarray, idf: np.ndarray, shares: np.ndarray, window: int, stride: int, floor: float) -> np.ndarray:
    """Sum over the windows of a ticket of the cosines that reach the floor, by topic."""
    size = min(window, len(tokens))
    starts = np.arange(0, len(tokens) - size + 1, stride)
    slots = [tokens[starts + i] for i in range(size)]
    # |window|^2: a word that occurs twice weighs four times, hence the cross terms.
    squares = sum(idf[s] * idf[s] for s in slots)
    for i in range(size):
        for j in range(i + 1, size):
            squares = squares + np.where(slots[i] == slots[j], 2 * idf[slots[i]] * idf[slots[i]], 0.0)
    length = np.sqrt(squares)
    # No cosine of a window is above the sum of its words' largest shares over its length.
    most = sum(shares.max(axis=1)[s] for s in slots)
    open_ = np.flatnonzero((length > 0) & (most * (1 + 1e-9) >= floor * length))
    total = np.zeros((len(open_), shares.shape[1]))
    for s in slots:
        total += shares[s[open_]]
    cosines = total / length[open_, None]
    return np.where(cosines >= floor, cosines, 0.0).sum(axis=0)


def topic_distribution(
    documents: DataFrame,
    weights: DataFrame,
    text: str = "text",
    window: int = 4,
    stride: int = 1,
    floor: float = 0.1,
) -> DataFrame:
    """Distribution of every ticket over the topics: ``system, id, topic, prob``.

    Every run of ``window`` words is compared with every topic by cosine in c-TF-IDF
    space; cosines under ``floor`` count as zero; the sum over a ticket's windows is
    scaled to one and rounded to four decimals. Topics without weight have no row. A
    ticket shorter than a window is one window.

    Common words, of which there are at most ``COMMON_SHARES`` whatever the corpus, are known to
    every task with the shares of the topics they occur in, and tickets name them by number, the
    most frequent ones by the smallest. Each other word of a ticket goes once to the directory; its
    place in the ticket comes back with its shares; no single one of them is in more than a small
    part of the tickets. There one pass
    slides over the words; windows whose largest shares cannot reach the floor are left out, and
    no window leaves the ticket. Texts that share an id are one ticket, no window reaches from one
    to the other.
    """
    tokens = documents.select("system", "id", words(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    kinds = dict(tokens.dtypes)
    ticket = f"system {kinds['system']}, id {kinds['id']}"
    # The common words, the join and the total read the directory.
    directory = stored(term_directory(weights))
    least = _least_count(directory)
    is_common = F.lit(False) if least is None else F.col("f") >= least
    common = _by_system(directory.where(is_common).toArrow().sort_by([("f", "descending")]))
    # As plain tuples: executors, which need not have this package, unpickle them.
    shared = documents.sparkSession.sparkContext.broadcast({system: tuple(own) for system, own in common.items()})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {system: _Common(*own) for system, own in shared.value.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, CODED_ROWS):
                yield _coded(batch.slice(start, CODED_ROWS), known)

    # A key for each row, which neither missing nor repeated ids or texts share; it is written with
    # the row, so both sides of the join see the same one.
    keyed = tokens.select("system", "id", F.monotonically_increasing_id().alias("key"), "tokens")
    coded = stored(keyed.mapInArrow(code, f"{ticket}, key long, codes array<int>, rest array<string>"))
    known = one_row_each(coded.select("system", "key", "rest"), "rest", "term", "place").join(
        directory.where(~is_common), ["system", "term"]
    )
    entry = F.struct("place", "idf", "topics", "shares")
    # Dealt by key first: gathering before the shuffle would only sort rows that hardly ever meet.
    gathered = known.select("key", entry.alias("entry")).repartition("key").groupBy("key").agg(F.collect_list("entry").alias("found"))
    whole = coded.join(gathered, "key", "left").select("system", "id", "codes", "found")

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {system: _Common(*own) for system, own in shared.value.items()}
        for batch in batches:
            row, topic, mass = [], [], []
            systems = batch.column(0).to_pylist()
            for at in range(batch.num_rows):
                entries = _entries(
                    batch.column(2)[at].values.to_numpy(), batch.column(3)[at].values, known.get(systems[at])
                )
                if entries is None:
                    continue
                sums = _mass(*entries, window, stride, floor)
                for t in np.flatnonzero(sums):
                    row.append(at), topic.append(t), mass.append(sums[t])
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(topic, pa.int32()), pa.array(mass, pa.float64())],
                names=["system", "id", "topic", "mass"],
            )

    slid = whole.mapInArrow(slide, f"{ticket}, topic int, mass double")
    summed = slid.repartition("system", "id").groupBy("system", "id", "topic").agg(F.sum("mass").alias("mass"))
    total = F.sum("mass").over(Window.partitionBy("system", "id"))
    return summed.select("system", "id", "topic", round4(F.col("mass") / total).alias("prob"))


def wide_distribution(distribution: DataFrame, assignments: DataFrame, k: int) -> DataFrame:
    """One column per topic, 0 where there is no weight, for the export of a system.

    A topic of k or more has no column: it is an error rather than left out, found while the
    rows are written.
    """
    allowed = F.when(
        F.col("topic") >= k, F.raise_error(F.concat(F.lit(f"topic beyond the {k} columns: "), F.col("topic").cast("string")))
    ).otherwise(F.col("topic"))
    pivoted = (
        distribution.withColumn("topic", allowed.cast("int"))
        .groupBy("system", "id")
        .pivot("topic", list(range(k)))
        .agg(F.first("prob"))
    )
    named = pivoted.select(
        "system", "id", *[F.col(f"`{t}`").alias(f"Topico {t}") for t in range(k)]
    )
    joined = assignments.select("system", "id", F.col("topic").alias("dominant_topic")).join(
        named, ["system", "id"], "left"
    )
    filled = [F.coalesce(F.col(f"`Topico {t}`"), F.lit(0.0)).alias(f"Topico {t}") for t in range(k)]
    return joined.select("system", *filled, "id", "dominant_topic")


def long_distribution(wide: DataFrame) -> DataFrame:
    """Back from the wide export to ``system, id, topic, prob`` rows."""
    topics = [c for c in wide.columns if c.startswith("Topico ")]
    return wide.unpivot(
        ["system", "id", "dominant_topic"], topics, "label", "prob"
    ).select(
        "system",
        "id",
        "dominant_topic",
        F.regexp_extract("label", r"^Topico (-?\d+)$", 1).cast("int").alias("topic"),
        F.col("prob").cast("double").alias("prob"),
    )
