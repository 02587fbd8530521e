"""Texts as sparse vectors: hashed words, weighted by how rare they are, at length one.

A word goes to the slot that the first 32 bits of its MD5 give, so every engine places it
alike. All that is learnt from a corpus is one number for each slot, at most ``features``,
which is what every task holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.text import words

# The task functions travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 1 << 18
VECTOR = "array<struct<slot: int, weight: double>>"


def slots(text: Column, features: int = FEATURES) -> Column:
    """Slot of every word of a text, in order."""
    place = lambda word: F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.transform(words(F.coalesce(text, F.lit(""))), lambda word: F.pmod(place(word), F.lit(features)).cast("int"))


def slot_weights(documents: DataFrame, text: str = "text", features: int = FEATURES) -> np.ndarray:
    """ln((n + 1) / (documents with a word in the slot + 1)) for every slot."""
    found = documents.select(slots(F.col(text), features).alias("slots"))
    total = documents.count()
    counts = np.zeros(features)
    counted = found.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").count().toArrow()
    counts[counted["slot"].to_numpy()] = counted["count"].to_numpy()  # at most one row for each slot
    return np.log((total + 1) / (counts + 1))


def encode(documents: DataFrame, weights: np.ndarray, text: str = "text", output: str = "embedding") -> DataFrame:
    """The documents with a sparse vector in ``output``; a text without words has no entries."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    features = len(weights)
    entry = pa.struct([("slot", pa.int32()), ("weight", pa.float64())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(output)
            of = column.value_parent_indices().to_numpy()
            pairs, times = np.unique(of * features + column.flatten().to_numpy(), return_counts=True)
            row, slot = np.divmod(pairs, features)
            weight = times * shared.value[slot]
            row, slot, weight = (a[weight > 0] for a in (row, slot, weight))
            lengths = np.sqrt(np.bincount(row, weight * weight, minlength=batch.num_rows))
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
            values = pa.StructArray.from_arrays(
                [pa.array(slot, pa.int32()), pa.array(weight / lengths[row], pa.float64())], fields=list(entry)
            )
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield batch.set_column(batch.schema.get_field_index(output), pa.field(output, made.type), made)

    placed = documents.withColumn(output, slots(F.col(text), features))
    form = documents.withColumn(output, F.lit(None).cast(VECTOR)).schema
    return placed.mapInArrow(vectors, form)
