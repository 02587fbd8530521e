"""Near-duplicates by MinHash with tensored banding and full verification.

A document is the set of its word shingles. Two small collections of minhash groups are
computed, GROUPS groups of two minhashes each; every pair of a group of the first and one of
the second is a table key, so 2 * GROUPS groups serve GROUPS * GROUPS tables and the number
of minhashes grows with the root of the number of tables. Texts with equal sets are merged
to one class before. At similarity 0.8 a link is missed by all tables with probability
2 * (1 - 0.8^2)^8 = 6e-4, at 0.9 with 3e-6.

Candidates never are all pairs of a table entry. The head of an entry is its class that
meets most others over all tables, the likely centre of a group; first every class is
compared with the HEADS heads it shares most keys with. Only entries whose classes then
still are in different components are looked at again. Shingles that no other class of these
entries has bound what a class can share with any partner, exactly, and rule out nearly all
of them: both edited copies too far from their group and texts that only share a passage.
What is left meets across components, each pair once, in the first key it shares. All pairs
compared are confirmed on the full shingle sets, and components are taken over these links.

Sets hold 64-bit hashes of shingles; classes are told apart by 128 bits.

Defined cases: a text that is null or has no words has an empty set and is linked with
nothing; one with fewer words than a shingle is a single shingle. Rows repeated under one id
share their component by text. A null id is larger than any other id in a component of
several ids, and a component of null ids has a null component_id and its rows are kept.
Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.links import components
from ticketloom.llm.storage import light_batches, stored
from ticketloom.operators.scale import salted_join

GROUPS = 8
WIDTH = 2
HEADS = 2
MINHASHES = 2 * GROUPS * WIDTH
BATCH_SHINGLES = 1 << 18  # shingles hashed at a time
CACHE_SHINGLES = 4_000_000  # of sets that a verifying task remembers
PERCENT = 80
CARRIED = 4  # differences of up to 1 / CARRIED of both sizes are carried along

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(1, 2**63, MINHASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**63, MINHASHES, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    mixed = np.full(len(found) - width + 1, np.uint64(width))
    for i in range(width):
        mixed = mixed * _P + hashes[i : len(found) - width + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _Q
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MINHASHES 32-bit minima per set; sets are not empty."""
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    found = np.empty((len(sets), MINHASHES), np.uint32)
    for i in range(MINHASHES):
        found[:, i] = np.minimum.reduceat((values * _FACTORS[i] + _SHIFTS[i]) >> np.uint64(32), starts)
    return found


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and minhashes of every row."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < batch.num_rows:
                sets, held, first = [], 0, at
                while at < batch.num_rows and held < BATCH_SHINGLES:
                    sets.append(shingles(texts[at].as_py(), words))
                    held += len(sets[-1])
                    at += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                minima: list = [None] * len(sets)
                for i, row in zip(full, minhashes([sets[i] for i in full]).view(np.int32) if full else ()):
                    minima[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, at - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(minima, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "minima"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(sketched, f"doc_id {kind}, n_shingles long, digest binary, minima array<int>")


def _group(collection: int, number: int) -> Column:
    at = (collection * GROUPS + number) * WIDTH
    return F.xxhash64(*[F.get("minima", F.lit(at + i)) for i in range(WIDTH)], F.lit(collection * GROUPS + number))


def _keys() -> Column:
    """The table keys: all pairs of a group of the first and one of the second collection."""
    return F.flatten(
        F.transform(
            F.array(*[_group(0, i) for i in range(GROUPS)]),
            lambda a: F.transform(F.array(*[_group(1, i) for i in range(GROUPS)]), lambda b: F.xxhash64(a, b)),
        )
    )


def _members(classes: DataFrame) -> DataFrame:
    """key, node, table and held of every class in the entries that several classes share.

    Spark sizes the exploded keys as if a class had one, and so would take either side for one
    to broadcast while there are 64 times as many rows: the join is told to sort both.
    """
    keyed = classes.select("node", F.posexplode(_keys()).alias("table", "key"))
    entries = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    return keyed.join(entries.hint("merge"), "key")


def _groups() -> Column:
    """All minhash groups, folded to 31 bits."""
    return F.array(
        *[F.pmod(_group(c, i), F.lit(1 << 31)).cast("int") for c in range(2) for i in range(GROUPS)]
    )


def _first_shared(a: Column, b: Column) -> Column:
    """The first table in which two classes have the same key."""
    equal = F.zip_with(a, b, lambda x, y: x == y)
    of = lambda c: F.array_position(F.slice(equal, c * GROUPS + 1, GROUPS), F.lit(True)) - 1
    return of(0) * GROUPS + of(1)


def verified(pairs: DataFrame, texts: DataFrame, words: int, differences: bool = False) -> DataFrame:
    """For each pair (a, b) of nodes what their full sets share, and whether it is enough;
    on demand, of pairs that are not too far apart, the shingles of only one of the two."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        held = 0

        def of(node: int, text: bytes) -> np.ndarray:
            nonlocal held
            if node not in cache:
                if held > CACHE_SHINGLES:
                    cache.clear()
                    held = 0
                cache[node] = shingles(text, words)
                held += len(cache[node])
            return cache[node]

        for batch in batches:
            nodes_a, nodes_b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shared, similar, changed = [], [], []
            for row in range(batch.num_rows):
                x = of(nodes_a[row], batch.column(2)[row].as_py())
                y = of(nodes_b[row], batch.column(3)[row].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                similar.append(100 * both >= PERCENT * (len(x) + len(y) - both))
                if differences:
                    by = len(x) + len(y) - 2 * both
                    near = CARRIED * by <= len(x) + len(y)
                    changed.append((np.setxor1d(x, y, assume_unique=True) >> np.uint64(33)).astype(np.int32) if near else None)
            columns = [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(similar, pa.bool_())]
            names = ["a", "b", "shared", "similar"]
            if differences:
                columns.append(pa.array(changed, pa.list_(pa.int32())))
                names.append("diff")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(
        compared, "a long, b long, shared long, similar boolean" + (", diff array<int>" if differences else "")
    )


def _texts(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """node and text for the given nodes (node, doc_id, digest)."""
    rows = docs.select(F.col(id_col).alias("own"), F.col(text_col).cast("binary").alias("text"))
    joined = rows.join(nodes, F.col("own").eqNullSafe(F.col("doc_id")))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Other texts under the same id go."""
        for batch in batches:
            digests, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            same = [_digest(shingles(t, words)) == d for d, t in zip(digests, texts)]
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(same, pa.bool_())) for c in (batch.column(0), batch.column(2))], names=["node", "text"]
            )

    return joined.select("node", "digest", "text").mapInArrow(own, "node long, text binary")


def _fits(most: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles that share ``most`` at best can reach the threshold."""
    return most * (100 + PERCENT) >= (n + m) * PERCENT


def _apart(most: Column, n: Column, m: Column) -> Column:
    """Whether sets that differ in ``most`` shingles or more miss the threshold."""
    return most * (100 + PERCENT) > (n + m) * (100 - PERCENT)


def _unshared(texts: DataFrame, words: int) -> DataFrame:
    """node and the number of its shingles that no other of the texts has."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), node)), pa.array(found)], names=["node", "shingle"]
                )

    return (
        texts.select("node", "text")
        .mapInArrow(exploded, "node long, shingle long")
        .groupBy("shingle")
        .agg(F.min("node").alias("node"), F.max("node").alias("other"))
        .where("node = other")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("unshared"))
    )


def near_dedup(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    light_batches(docs.sparkSession)
    rows = stored(sketches(docs, words, id_col, text_col), "sketches")
    # One class per set. Its node is half of its digest.
    classes = stored(
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n"),
            F.first("minima").alias("minima"),
        )
        .withColumn("node", F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")),
        "classes",
    )
    members = stored(_members(classes), "members")
    sizes = classes.select("node", "n")

    # First round: every class and the heads it shares most keys with.
    centrality = members.groupBy("node").agg(F.sum("held").alias("met"))
    scored = members.select("key", "node").join(centrality, "node")
    heads = scored.groupBy("key").agg(F.max(F.struct("met", "node")).alias("head")).select("key", F.col("head.node").alias("head"))
    votes = (
        members.select("key", "node")
        .join(heads, "key")
        .where("node <> head")
        .groupBy("node", "head")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    of_head = sizes.select(F.col("node").alias("head"), F.col("n").alias("m"))
    votes = votes.join(sizes, "node").join(of_head, "head").where(_fits(F.least("n", "m"), F.col("n"), F.col("m")))
    best = Window.partitionBy("node").orderBy(F.desc("votes"), "head")
    pairs = votes.withColumn("place", F.row_number().over(best)).where(F.col("place") <= HEADS)
    pairs = stored(pairs.select(F.col("head").alias("a"), F.col("node").alias("b"), "n", "m", "place"), "pairs")
    needed = members.select("node").distinct().join(classes.select("node", "doc_id", "digest"), "node")
    texts = stored(_texts(docs, needed, words, id_col, text_col), "texts")
    compared = stored(verified(pairs, texts, words, differences=True).distinct(), "compared")
    links = compared.where("similar").select("a", "b")
    tied = stored(components(links), "tied")
    # By how many shingles, and which, a class differs from the head that it is nearest to.
    differs = compared.join(pairs.where("place = 1"), ["a", "b"]).select(
        F.col("b").alias("node"), F.col("a").alias("head"), (F.col("n") + F.col("m") - 2 * F.col("shared")).alias("by"), "diff"
    )

    # Second round: pairs of one entry that are in different components by now.
    placed = (
        members.select("key", "table", "node")
        .join(tied, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    open_ = stored(placed.join(mixed.select("key"), "key"), "open")
    open_texts = texts.join(open_.select("node").distinct(), "node", "left_semi")
    bounded = (
        open_.join(sizes, "node")
        .join(_unshared(open_texts, words), "node", "left")
        .withColumn("most", F.col("n") - F.coalesce("unshared", F.lit(0)))
    )
    bounded = stored(bounded.drop("unshared"), "bounded")
    smallest = bounded.groupBy("key").agg(F.min("n").alias("least"))
    able = bounded.join(smallest, "key").where(_fits(F.col("most"), F.col("n"), F.greatest("least", F.col("n") * PERCENT / 100)))
    able = stored(able.drop("least"), "able")
    # All classes of an entry meet those outside its largest component.
    mixed = (
        able.groupBy("key", "component")
        .agg(F.count(F.lit(1)).alias("held"))
        .groupBy("key")
        .agg(F.max(F.struct("held", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select("key", F.col("main.component").alias("main"))
    )
    still = (
        able.join(mixed, "key")
        .join(classes.select("node", _groups().alias("groups")), "node")
        .join(differs, "node", "left")
    )
    right = stored(still, "still")
    left = right.where("component <> main").select(
        *[F.col(c).alias(f"{c}_b") for c in ("key", "node", "component", "n", "most", "groups", "head", "by", "diff")]
    )
    # Through a common head: what two classes share of their differences from it is at most
    # the smaller one's, less the shingles that nobody else has; where the differences are at
    # hand, it is what they have in common.
    n, n_b = F.col("n"), F.col("n_b")
    able_to_share = F.least(F.col("by") - n + F.col("most"), F.col("by_b") - n_b + F.col("most_b"))
    at_least = F.col("by") + F.col("by_b") - 2 * able_to_share
    exactly = F.col("by") + F.col("by_b") - 2 * F.size(F.array_intersect("diff", "diff_b"))
    same_head = F.col("head") == F.col("head_b")
    component, component_b, main = F.col("component"), F.col("component_b"), F.col("main")
    more = right.join(
        left,
        (F.col("key") == F.col("key_b"))
        & ((component < component_b) | ((component == main) & (component > component_b)))
        & _fits(F.least("most", "most_b"), n, n_b)
        & ~F.coalesce(same_head & _apart(at_least, n, n_b), F.lit(False))
        & (_first_shared(F.col("groups"), F.col("groups_b")) == F.col("table"))
        & ~F.coalesce(same_head & _apart(exactly, n, n_b), F.lit(False)),
    ).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
    more = stored(more.distinct(), "more")
    links = links.unionByName(verified(more, texts, words).where("similar").select("a", "b").distinct())
    tied = components(links)

    # Back to the rows: the smallest id of the component of the row's class.
    of_class = classes.join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = stored(of_class.join(ids, "component").select("digest", "copies", "component_id"), "known")
    own = rows.select("doc_id", "n_shingles", "digest")
    found = salted_join(own.where("digest is not null"), known, ["digest"], "copies", ["doc_id"])
    empty = own.where("digest is null").withColumn("component_id", F.col("doc_id"))
    return (
        found.select("doc_id", "n_shingles", "component_id")
        .unionByName(empty.select("doc_id", "n_shingles", "component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, one document of each group."""
    kept = near_dedup(docs, words).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    matched = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return matched.withColumn("_again", F.row_number().over(again)).where("_again = 1").drop("_again")
