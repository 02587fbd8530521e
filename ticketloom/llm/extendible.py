"""Exact deduplication through an extendible-hash index on shared files, in DataFrame operations.

The key of a text is a 64-bit hash of its normal form. Rows are shuffled by key and whole
normal form after the map side has merged equal ones, so bytes decide and texts whose keys
collide become separate links of one chain. A directory maps the leading bits of a key to a
bucket: a bucket that holds more than ``capacity`` links is split at its next bit, and the
directory doubles while a split needs one more bit than it has. Every owner task then writes
one contiguous range of buckets, in key order, to the shared folder. A text is looked up by
way of the directory, which names its bucket, and by its key and digest in the chains of that
bucket; heavy keys are dealt to several tasks.

Defined cases: a null text counts as empty and equals other empty texts; a text of white
space only equals a single space. ``kept`` marks the rows of the smallest ``doc_id`` of a
group; a null ``doc_id`` is larger than any other, and a group of null ids keeps them. Rows
repeated under one id and text are one document and carry the same decision. An empty table
gives an empty result. Only the two named columns are read, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.storage import stored
from ticketloom.operators.scale import salted_join

CAPACITY = 16_384  # links a bucket holds before it is split
MAX_DEPTH = 16  # bits of the largest directory, which so has 65 536 cells at most
SPARE_BITS = 4  # splits beyond an even spread that the directory foresees


def normal_form(text: Column) -> Column:
    """Every run of white space as one space; a lone space is matched by neither branch."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "
    )


def text_key(normal: Column) -> Column:
    return F.xxhash64(normal)


def chains(docs: DataFrame, id_col: str, text_col: str, key=text_key) -> DataFrame:
    """One link per distinct text: key, the id that stays, the copies, the digest."""
    normal = docs.select(F.col(id_col).alias("doc_id"), normal_form(F.col(text_col)).alias("normal"))
    return (
        normal.groupBy(key(F.col("normal")).alias("key"), "normal")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", "keep_id", "group_size", F.sha2("normal", 256).alias("digest"))
    )


def directory(links: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Cell (leading bits of a key) to bucket, after all splits.

    A bucket of local depth d is a prefix of d bits. The one a cell ends in is the shortest
    prefix with no more than ``capacity`` links, which is where repeated doubling stops; a
    prefix as long as the directory is deep keeps the rest as overflow.
    """
    total = links.count()
    depth = max(0, (max(total, 1) - 1) // capacity).bit_length()
    depth = min(MAX_DEPTH, depth + SPARE_BITS if depth else 0)
    cells = links.groupBy(cell(F.col("key"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    doubled = cells.select(
        "cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    fits = (
        doubled.groupBy("depth", "prefix")
        .agg(F.sum("n").alias("held"))
        .where((F.col("held") <= capacity) | (F.col("depth") == depth))
        .select("depth", "prefix")
    )
    return (
        doubled.join(fits, ["depth", "prefix"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "prefix")).alias("bucket"))
        .select(
            "cell",
            F.col("bucket.depth").alias("depth"),
            F.expr(f"shiftleft(bucket.prefix, {depth} - bucket.depth)").alias("bucket"),
            F.lit(depth).alias("bits"),
        )
    )


def cell(key: Column, bits: int) -> Column:
    """Leading bits of a key as a number from 0."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def routed(rows: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """Rows with a key and the bucket that the directory names for it.

    The directory has at most 65 536 rows by definition, which bounds its broadcast.
    """
    placed = rows.withColumn("cell", cell(F.col("key"), bits))
    return placed.join(F.broadcast(table.drop("bits")), "cell").drop("cell")


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key=text_key
) -> tuple[DataFrame, DataFrame, int]:
    """The index on shared files (bucket, depth, key, keep_id, group_size, digest), its directory and its bits."""
    links = stored(chains(docs, id_col, text_col, key), "links")
    table = stored(directory(links, capacity).coalesce(1), "directory")
    bits = (table.agg(F.max("bits")).first()[0]) or 0
    owned = routed(links, table, bits).repartitionByRange("bucket", "key")
    return stored(owned.sortWithinPartitions("bucket", "key", "keep_id"), "index"), table, bits


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key=text_key
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    index, table, bits = build_index(docs, id_col, text_col, capacity, key)
    normal = normal_form(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), key(normal).alias("key"), F.sha2(normal, 256).alias("digest")
    )
    found = salted_join(
        routed(rows, table, bits).drop("depth"),
        index.select("bucket", "key", "digest", "keep_id", "group_size", F.col("group_size").alias("weight")),
        ["bucket", "key", "digest"],
        "weight",
        ["doc_id"],
    )
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one for each distinct text."""
    kept = exact_dedup(docs).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")
    ).distinct()
    own = F.sha2(normal_form(docs["text"]), 256)
    matched = docs.withColumn("_own", own).join(
        kept, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")), "left_semi"
    )
    return matched.dropDuplicates(["doc_id", "_own"]).select(*[matched[c] for c in docs.columns])
