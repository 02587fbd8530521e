"""Partitioning helpers shared by the operators."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARES of all rows, so there are
# never more than HOT_SHARES hot keys, whatever the data.
HOT_SHARES = 4_000
# Numbers that keys are hashed to, and so the most that a filter by keys broadcasts.
FILTER_SLOTS = 1 << 22


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Use every core on a scan that has fewer splits than the cluster has cores.

    A large input has more splits than cores and is returned untouched, so no
    shuffle is added where it would cost something.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def one_row_each(
    df: DataFrame, array: str, name: str, position: str | None = None
) -> DataFrame:
    """One row per element of a computed array; NULL elements count as none.

    The outer form with a filter behind it: for the inner form Spark adds a size test
    in front, which it pushes to the scan and which computes the array a second time.
    """
    kept = [F.col(c) for c in df.columns if c != array]
    if position is None:
        flat = df.select(*kept, F.explode_outer(array).alias(name))
    else:
        flat = df.select(*kept, F.posexplode_outer(array).alias(position, name))
    return flat.where(F.col(name).isNotNull())


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    weight: str,
    spread_by: list[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join of many rows with a keyed table when single keys may be hot.

    ``lookup`` holds each key once, with the number of rows that carry it in
    ``weight``. Hot keys are cut into slices on the row side and repeated per slice
    on the lookup side; all other keys join as they are. The list of hot keys has at
    most ``HOT_SHARES`` rows by definition, which is what makes its broadcast safe.
    """
    total = lookup.agg(F.sum(weight)).scalar()
    slices = F.ceil(F.col(weight) * HOT_SHARES / total).cast("int")
    sized = lookup.withColumn("_slices", slices)
    hot = sized.where("_slices > 1").select(*keys, F.col("_slices").alias("_hot"))
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_hot", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_slice", salt).drop("_hot")
    repeated = sized.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.greatest("_slices", F.lit(1)) - 1))
    ).drop("_slices", weight)
    return salted.join(repeated, [*keys, "_slice"], how).drop("_slice")


def likely_matches(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be in ``lookup``, for a join that would else move wide rows in vain.

    Keys are hashed to ``FILTER_SLOTS`` numbers; those in use are broadcast, never more than there
    are slots. No row with a partner is lost, the few without one that stay are for the join to
    drop. The key has the same type on both sides.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_SLOTS))
    used = lookup.select(slot.alias("_slot")).distinct()
    return rows.join(F.broadcast(used), slot == F.col("_slot"), "left_semi")


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows of each group.

    Spark cuts every map-side partition to k rows per group before the shuffle, so a
    group that holds a third of all rows never meets in one task.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


@functools.cache
def _local_folder() -> str:
    """The machine's own scratch of this process, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="ticketloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Path of a folder, not there yet, that every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``; a checkpoint folder
    set on the context counts too. Only a local master may fall back to the machine's
    own temporary folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/ticketloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back.

    For a table several branches of a plan use, and for the lesser side of a join (one row
    per topic or system): it is computed once, its lineage ends here, a lost executor costs
    no recomputation of what led to it, and Spark picks the join by its true size, so that
    a small side is broadcast and a large one is not.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
