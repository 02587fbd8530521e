"""A ledger of stages: what was made, from what, with which parameters and by which version.

The digest of a stage covers its name, its version, its parameters and the digests of what it
reads. A run goes through its stages in order; those whose digest is on record are read back,
and from the first that differs on everything behind it is made anew, since digests follow.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.sources.readers import exists


def content_digest(df: DataFrame, *columns: str) -> str:
    """A digest of the rows, whatever their order: count, sum and xor of two hashes of each."""
    row = [F.xxhash64(F.lit(salt), *(columns or df.columns)) for salt in (1, 2)]
    sums = [F.sum(h.cast("decimal(20,0)")) for h in row] + [F.bit_xor(h) for h in row]
    return digest(*(str(v) for v in df.agg(F.count(F.lit(1)), *sums).first()))


def digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class Ledger:
    """Stages of one job below a folder, one record each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.made: list[str] = []  # stages this run made, in order

    def _record(self, stage: str) -> str:
        return f"{self.path}/ledger/{stage}"

    def known(self, stage: str) -> tuple[str | None, dict]:
        """Digest and notes on record."""
        if not exists(self.spark, self._record(stage)):
            return None, {}
        row = self.spark.read.schema("digest string, notes string").json(self._record(stage)).first()
        return (row["digest"], json.loads(row["notes"])) if row else (None, {})

    def stage(
        self, stage: str, version: int, parameters: Mapping, inputs: list[str], make: Callable[[], dict | None]
    ) -> tuple[str, dict]:
        """Runs ``make`` unless the stage is on record with the same digest; digest and notes.

        The record goes before the work starts and comes back when it is done, so what a broken
        run left is never taken for whole.
        """
        wanted = digest(stage, version, dict(parameters), inputs)
        held, notes = self.known(stage)
        if held == wanted:
            return wanted, notes
        self._write(stage, "", {})
        notes = make() or {}
        self._write(stage, wanted, notes)
        self.made.append(stage)
        return wanted, notes

    def _write(self, stage: str, value: str, notes: dict) -> None:
        rows = [(value, json.dumps(notes, sort_keys=True))]
        frame = self.spark.createDataFrame(rows, "digest string, notes string")
        frame.coalesce(1).write.mode("overwrite").json(self._record(stage))
