"""Records of CSV files whose quoted fields hold line ends, read by splits in parallel.

Lines are read as text, split by split. Whether a split begins inside a quoted field follows
from the number of quotes in front of it: they are counted by split and summed up over the
splits of a file. Each split then cuts its lines into records where the number of quotes so far
is even; what it holds of a record that began before it, or goes on behind it, is a fragment,
and fragments are put together by file. Only the table of splits, one row each, goes through
the driver, which plans a task for each of them anyway.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.operators.scale import stored

# The task functions travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, ENDS, BEGINS = 0, 1, 2  # a record; the rest of one, or a part of its middle; its first part
_CUT = "file string, split long, place long, kind int, record string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, line`` in order within a split; the split is its first byte."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").alias("line"),
    )


def open_splits(rows: DataFrame) -> list[tuple[str, int]]:
    """The splits that begin inside a quoted field."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = rows.groupBy("file", "split").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1
    found = counted.withColumn("odd", odd).where("odd").select("file", "split")
    return [(r["file"], r["split"]) for r in found.collect()]  # at most one row a split


def _cut(rows: DataFrame) -> DataFrame:
    """Records and fragments of every split, numbered within it."""
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(open_splits(rows)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, odd, kind, place = None, [], False, WHOLE, 0
        out: list[tuple] = []

        def close(as_kind: int) -> None:
            nonlocal place
            if held:
                out.append((*here, place, as_kind, "\n".join(held)))
                held.clear()
                place += 1

        for batch in batches:
            for file, split, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split) != here:
                    if here is not None:
                        close(ENDS if kind == ENDS else BEGINS)  # an open end of a split
                    here, place = (file, split), 0
                    odd = here in shared.value
                    kind = ENDS if odd else WHOLE
                held.append(line)
                odd ^= line.count('"') % 2 == 1
                if not odd:
                    close(kind)
                    kind = WHOLE
            if len(out) > 1000:
                yield _batch(out)
                out.clear()
        if here is not None:
            close(ENDS if kind == ENDS else BEGINS)
        if out:
            yield _batch(out)

    return rows.mapInArrow(cut, _CUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names=["file", "split", "place", "kind", "record"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, place, record`` of all records but empty ones; a record counts where it begins.

    The number of fragments is at most two for each split, so putting them together moves
    little of the text. The parts are stored: splits are cut once, whatever reads the records.
    """
    parts = stored(_cut(lines(spark, path)))
    whole = parts.where(F.col("kind") == WHOLE)
    fragments = parts.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("split", "place")
    begun = F.when(F.col("kind") == BEGINS, F.struct("split", "place"))
    owned = fragments.withColumn("_owner", F.last(begun, ignorenulls=True).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("split", "place", "record")))
    joined = (
        owned.groupBy("file", "_owner")
        .agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
        .select("file", "_owner.split", "_owner.place", "record")
    )
    found = whole.select(*joined.columns).unionByName(joined)
    return found.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.col("record") != "")


def without_headers(rows: DataFrame) -> DataFrame:
    """Records but the first of each file."""
    return rows.where((F.col("split") > 0) | (F.col("place") > 0))


def numbered(rows: DataFrame, name: str = "position") -> DataFrame:
    """Records with their number over all files, in the order of file, split and place, from 0.

    Places within a split are counted up to the offset of the split, a running sum over the
    table of splits; rows of a split are ranked without the records of others.
    """
    counts = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("file", "split").orderBy("place")
    own = rows.withColumn("_own", F.row_number().over(inside) - 1)
    return own.join(offsets, ["file", "split"]).withColumn(name, (F.col("_offset") + F.col("_own")).cast("long")).drop("_offset", "_own")
