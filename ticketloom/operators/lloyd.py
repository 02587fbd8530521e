"""Many k-means fits by shared scans of one table of vectors.

Every pass over the vectors serves all fits that still move, whatever their number of centres,
start or number of leading components: a task multiplies its vectors with all their centres at
once and gives out one sum for each centre, Spark adds these up, and the driver moves the
centres. Fits that stand still drop out. What the driver and the tasks hold is the centres, a
number that the settings give and the vectors do not.

Starts are those of k-means||: a first centre by a seeded hash, rounds that draw about twice k
vectors in proportion to their squared distance, and a weighted k-means++ over what was drawn.
Draws depend on seed and vector alone, so a repeated pass draws the same.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators.scale import stored

# The task functions travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_STEPS = 300
TOLERANCE = 1e-4
INIT_ROUNDS = 2
TILE_ROWS = 2_048
TASK_ROWS = 20_000  # vectors that are worth a task of their own, at least
MEANS = "fit int, centre int, n long, total array<double>, cost double"


@dataclass
class Fit:
    """One start: k centres over the first ``size`` components (None: all)."""

    k: int
    seed: int
    size: int | None = None
    centres: np.ndarray = field(default=None, repr=False)
    cost: float = float("inf")
    steps: int = 0

    def transform(self, df: DataFrame, features: str = "features", output: str = "prediction") -> DataFrame:
        """Adds the number of the nearest centre, the first of those at the same distance."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="int32")
            gaps = _gaps(np.stack(vectors.to_numpy())[:, : centres.shape[1]], centres)
            return pd.Series(gaps.argmin(axis=1).astype("int32"))

        return df.withColumn(output, nearest(vector_to_array(features)))

    def write(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c.tolist(), self.k, self.seed, self.size, float(self.cost), self.steps) for i, c in enumerate(self.centres)]
        form = "centre int, at array<double>, k int, seed long, size int, cost double, steps int"
        spark.createDataFrame(rows, form).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Fit:
        rows = spark.read.parquet(path).orderBy("centre").collect()  # one row for each centre
        first = rows[0]
        centres = np.array([r["at"] for r in rows])
        return cls(first["k"], first["seed"], first["size"], centres, first["cost"], first["steps"])


def _gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] - 2 * (rows @ centres.T) + (centres * centres).sum(1)[None, :]


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A uniform number for each key and salt."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def table(vectors: DataFrame, features: str = "features") -> DataFrame:
    """The vectors as plain arrays with a key of each, stored for many passes."""
    values = vectors.select(vector_to_array(features).alias("x"))
    held = stored(values.select(F.xxhash64("x").alias("key"), "x"))
    return held.coalesce(max(1, -(-held.count() // TASK_ROWS)))  # no more tasks than the rows are worth


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(at, TILE_ROWS)
            rows = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0).to_numpy(), rows.reshape(part.num_rows, -1)


def _rated(rows: np.ndarray, centres: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Squared distances of the rows to the centres of each fit, one after the other.

    A table of one fit stays in the processor's cache; one of hundreds would go through memory at each step.
    """
    squares = {size: (rows[:, :size] * rows[:, :size]).sum(1)[:, None] for size in {c.shape[1] for c in centres}}
    for i, own in enumerate(centres):
        size = own.shape[1]
        yield i, squares[size] - 2 * (rows[:, :size] @ own.T) + (own * own).sum(1)[None, :]


def means(data: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """One pass: members, sum of vectors and cost of every centre of every fit, one row each.

    The centres go along with the task, which Spark hands out once to each executor.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(c.shape) for c in centres]
        counts = [np.zeros(len(c), np.int64) for c in centres]
        costs = [np.zeros(len(c)) for c in centres]
        for _, rows in _tiles(batches):
            for i, gaps in _rated(rows, centres):
                nearest = gaps.argmin(axis=1)
                k, size = centres[i].shape
                counts[i] += np.bincount(nearest, minlength=k)
                costs[i] += np.bincount(nearest, np.maximum(gaps[np.arange(len(rows)), nearest], 0), minlength=k)
                for d in range(size):
                    totals[i][:, d] += np.bincount(nearest, rows[:, d], minlength=k)
        flat = [(i, c, counts[i][c], totals[i][c], costs[i][c]) for i in range(len(centres)) for c in np.flatnonzero(counts[i])]
        if flat:
            fit, centre, n, total, cost = zip(*flat)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fit, pa.int32()), pa.array(np.array(centre), pa.int32()), pa.array(n, pa.int64()),
                    pa.array([t.tolist() for t in total], pa.list_(pa.float64())), pa.array(cost, pa.float64()),
                ],
                names=["fit", "centre", "n", "total", "cost"],
            )

    parts = data.mapInArrow(summed, MEANS)
    return parts.groupBy("fit", "centre").agg(
        F.sum("n").alias("n"),
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
        F.sum("cost").alias("cost"),
    )


def _collected(data: DataFrame, centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Counts, means (old ones for centres without members) and cost of every fit."""
    counts = [np.zeros(len(c), np.int64) for c in centres]
    moved = [c.copy() for c in centres]
    costs = np.zeros(len(centres))
    for row in means(data, centres).toArrow().to_pylist():  # one row for each centre
        i, c = row["fit"], row["centre"]
        counts[i][c] = row["n"]
        moved[i][c] = np.array(row["total"]) / row["n"]
        costs[i] += row["cost"]
    return counts, moved, costs


def _first_centres(data: DataFrame, seeds: Sequence[int]) -> dict[int, np.ndarray]:
    """For every seed the vector with the lowest seeded hash."""

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for keys, rows in _tiles(batches):
            for seed in seeds:
                order = _mixed(keys, seed)
                at = int(order.argmin())
                found = (float(order[at]), rows[at].tolist())
                best[seed] = min(best.get(seed, found), found)
        if best:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(best), pa.int64()), pa.array([o for o, _ in best.values()], pa.float64()),
                    pa.array([x for _, x in best.values()], pa.list_(pa.float64())),
                ],
                names=["seed", "draw", "x"],
            )

    drawn = data.mapInArrow(lowest, "seed long, draw double, x array<double>")
    best = drawn.groupBy("seed").agg(F.min(F.struct("draw", "x")).alias("best")).toArrow().to_pylist()  # one row a seed
    return {r["seed"]: np.array(r["best"]["x"]) for r in best}


def _drawn(data: DataFrame, fits: list[Fit], candidates: list[np.ndarray], costs: np.ndarray, step: int) -> list[np.ndarray]:
    """About 2 k further candidates for every fit, each vector by its share of the cost."""
    settings = [(f.k, f.seed) for f in fits]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows in _tiles(batches):
            for i, gaps in _rated(rows, candidates):
                k, seed = settings[i]
                if costs[i] <= 0:
                    continue
                chance = 2 * k * np.maximum(gaps.min(axis=1), 0) / costs[i]
                taken = np.flatnonzero(_mixed(keys, (seed * 1009 + k) * 31 + step) < chance)
                if len(taken):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(taken), i), pa.int32()), pa.array(keys[taken], pa.int64()),
                            pa.array([rows[t].tolist() for t in taken], pa.list_(pa.float64())),
                        ],
                        names=["fit", "key", "x"],
                    )

    # Equal vectors are one candidate, so a vector that fills a third of the table stays one row.
    found = data.mapInArrow(draw, "fit int, key long, x array<double>").groupBy("fit", "key", "x").count()
    more: list[list] = [[] for _ in fits]
    for row in sorted(found.toArrow().to_pylist(), key=lambda r: (r["fit"], r["key"], r["x"])):
        more[row["fit"]].append(row["x"])
    return [
        np.concatenate((old, np.array(new)[:, : old.shape[1]])) if new else old for old, new in zip(candidates, more)
    ]


def _chosen(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ and Lloyd steps over the candidates of a fit; all of them if they are few."""
    held = weights > 0
    candidates, weights = candidates[held], weights[held].astype(np.float64)
    if len(candidates) <= k:
        return candidates
    random = np.random.default_rng(seed)
    centres = candidates[[random.choice(len(candidates), p=weights / weights.sum())]]
    while len(centres) < k:
        chance = weights * np.maximum(_gaps(candidates, centres).min(axis=1), 0)
        if chance.sum() <= 0:
            return centres
        centres = np.concatenate((centres, candidates[[random.choice(len(candidates), p=chance / chance.sum())]]))
    for _ in range(30):
        nearest = _gaps(candidates, centres).argmin(axis=1)
        total = np.bincount(nearest, weights, minlength=k)
        moved = np.stack([np.bincount(nearest, weights * candidates[:, d], minlength=k) for d in range(candidates.shape[1])], axis=1)
        moved = np.where(total[:, None] > 0, moved / np.maximum(total, 1e-300)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def started(data: DataFrame, fits: list[Fit]) -> list[Fit]:
    """The fits with their first centres."""
    first = _first_centres(data, sorted({f.seed for f in fits}))
    if not first:
        return fits
    candidates = [first[f.seed][None, : f.size] for f in fits]
    for step in range(INIT_ROUNDS):
        _, _, costs = _collected(data, candidates)
        candidates = _drawn(data, fits, candidates, costs, step)
    counts, _, _ = _collected(data, candidates)
    for fit, own, weights in zip(fits, candidates, counts):
        fit.centres = _chosen(own, weights, fit.k, fit.seed)
    return fits


def _spread(data: DataFrame) -> np.ndarray:
    """Variance of every component."""
    found = data.agg(vector_to_array(Summarizer.variance(array_to_vector("x"))).alias("v")).first()["v"]
    return np.array(found if found is not None else [])


def moved(data: DataFrame, fits: list[Fit], most: int = MOST_STEPS, tolerance: float = TOLERANCE) -> list[Fit]:
    """Lloyd steps until the centres of a fit move by less than a share of the variance; then one pass for the costs.

    The squared moves of all centres together are held against ``tolerance`` times the mean
    variance of the components the fit sees.
    """
    open_ = [f for f in fits if f.centres is not None]
    if not open_:
        return fits
    variances = _spread(data)
    while open_ and open_[0].steps < most:
        _, centres, _ = _collected(data, [f.centres for f in open_])
        still = []
        for fit, new in zip(open_, centres):
            shift = ((new - fit.centres) ** 2).sum()
            fit.centres, fit.steps = new, fit.steps + 1
            if shift > tolerance * variances[: fit.size].mean():
                still.append(fit)
        open_ = still
    done = [f for f in fits if f.centres is not None]
    _, _, costs = _collected(data, [f.centres for f in done])
    for fit, cost in zip(done, costs):
        fit.cost = float(cost)
    return fits


def fit_all(vectors: DataFrame, settings: Sequence[tuple[int, int, int | None]], features: str = "features") -> list[Fit]:
    """A fit for every (k, seed, size), all by the same passes; vectors are stored once."""
    data = table(vectors, features)
    return moved(data, started(data, [Fit(*s) for s in settings]))


def cheapest(fits: Sequence[Fit]) -> Fit:
    """The first fit with the lowest cost."""
    return min(fits, key=lambda fit: fit.cost)
