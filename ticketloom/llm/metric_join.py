"""Near-duplicate vectors by an exact metric range join.

Vectors of one label and dimension are compared. On unit vectors a cosine of at least c is a
distance of at most e = sqrt(2 - 2c). Large labels get pivots; every vector lives in the cell
of its nearest pivot and is copied to each cell whose boundary is within reach: by the
triangle inequality a vector x at home with p can have a partner in the cell of q only if
d(x, q) - d(x, p) <= 2e, and in flat space only if (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= e.
A cell then holds all partners of the vectors at home in it and joins by itself. Cells are
cut into blocks of bounded size; a block pair counts links and emits a spanning forest of
them, never the pairs.

Equal vectors are merged before and counted after, so a common vector is one row.

Defined cases: vectors that are null, empty, all zero or hold a null or a non-finite value,
and vectors with a null label, link with nothing. Vectors of different dimension do not
link. Rows repeated under one id are different vectors that link with each other. A null id
is larger than any other. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.links import components
from ticketloom.llm.storage import stored
from ticketloom.operators.scale import salted_join

COSINE = 0.93
CELL_ROWS = 2_048  # vectors of a label for each pivot
MAX_PIVOTS = 4_096  # of all labels together, which bounds their broadcast
HOME_BLOCK = 1_024
BLOCK = 4_096
SLACK = 1e-6  # on distances, against rounding, which takes a difference of squares to 4e-8


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def reach(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))) + SLACK


def cells_of(x: np.ndarray, pivots: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and for each cell whether the vector is needed there."""
    far, limit = distances(x, pivots), reach(cosine)
    home = far.argmin(1)
    near = far[np.arange(len(x)), home][:, None]
    between = np.maximum(distances(pivots, pivots)[home], 1e-12)
    needed = (far - near <= 2 * limit) & ((far**2 - near**2) / (2 * between) <= limit + SLACK)
    needed[np.arange(len(x)), home] = True
    return home, needed


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest row that each row and then each column reaches in a matrix of links.

    Columns without a link get the number of rows.
    """
    rows, columns = linked.shape
    found = np.concatenate((np.arange(rows), np.full(columns, rows)))
    own, other = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(own):
        return found
    some = linked[np.ix_(own, other)]
    low = own.copy()
    while True:
        low_c = np.where(some, low[:, None], rows).min(0)
        after = np.minimum(low, np.where(some, low_c[None, :], rows).min(1))
        if (after == low).all():
            break
        low = after
    found[own], found[rows + other] = low, low_c
    return found


def _usable(vector, label):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(some, F.lit(False)), F.lit(False))


def near_vectors(
    table: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = table.sparkSession
    rows = table.select(
        F.col(id_col).alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).withColumn("usable", _usable(F.col("vector"), F.col("label")))
    fit = rows.where("usable")
    # A node is the 64-bit hash of a label and vector.
    distinct = fit.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = stored(
        distinct.withColumns({"node": F.xxhash64("label", "vector"), "dimension": F.size("vector")}), "distinct"
    )
    groups = distinct.groupBy("label", "dimension").agg(F.count(F.lit(1)).alias("held"))
    total = groups.agg(F.sum("held")).first()[0] or 0
    share = min(1.0 / cell_rows, MAX_PIVOTS / 2 / max(1, total))
    chosen = (
        distinct.join(groups.where(F.col("held") > cell_rows).select("label", "dimension"), ["label", "dimension"])
        .where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 30)) < int(share * (1 << 30)))
        .select("label", "dimension", "node", "vector")
        .orderBy("node")
        .limit(MAX_PIVOTS)
        .toPandas()
    )
    by_group = {key: _unit(_matrix(g["vector"])) for key, g in chosen.groupby(["label", "dimension"])}
    pivots = spark.sparkContext.broadcast(by_group)
    columns = ["label", "dimension", "cell", "home", "node", "copies", "vector"]

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, group in batch.groupby(["label", "dimension"], sort=False):
                known = pivots.value.get(key)
                if known is None:
                    yield group.assign(cell=0, home=True)[columns]
                    continue
                home, needed = cells_of(_unit(_matrix(group["vector"])), known, cosine)
                row, cell = np.nonzero(needed)
                for at in range(0, len(row), BLOCK):
                    some = row[at : at + BLOCK]
                    where = cell[at : at + BLOCK]
                    yield group.iloc[some].assign(cell=where, home=home[some] == where)[columns]

    placed = stored(
        distinct.select("label", "dimension", "node", "copies", "vector").mapInPandas(
            assigned, "label string, dimension int, cell int, home boolean, node long, copies long, vector array<double>"
        ),
        "cells",
    )
    cell = ["label", "dimension", "cell"]
    sizes = placed.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("home").cast("int")) / HOME_BLOCK).cast("int").alias("homes"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("held"),
    ).where("homes > 0")
    sized = salted_join(placed, sizes, cell, "held", ["node"])
    number = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    at_home = sized.where("home").select(
        *cell, number("homes", 1).alias("h"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"),
        F.lit(True).alias("home"), "node", "copies", "vector",
    )
    partners = sized.select(
        *cell, F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("h"), number("blocks", 2).alias("b"),
        F.lit(False).alias("home"), "node", "copies", "vector",
    )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        home, others = group[group["home"]], group[~group["home"]]
        if home.empty or others.empty:
            return pd.DataFrame({"node": [], "other": [], "links": []}).astype("int64")
        x, y = _unit(_matrix(home["vector"])), _unit(_matrix(others["vector"]))
        linked = x @ y.T >= cosine
        nodes, partner = home["node"].to_numpy(), others["node"].to_numpy()
        linked[nodes[:, None] == partner[None, :]] = False
        links = linked @ others["copies"].to_numpy().astype(np.float64)
        root = forest(linked)
        reached = root < len(nodes)
        found = np.concatenate((nodes, partner))
        tied = reached & (found != nodes[np.minimum(root, len(nodes) - 1)])
        return pd.concat(
            [
                pd.DataFrame({"node": nodes, "other": nodes, "links": links.astype(np.int64)}),
                pd.DataFrame({"node": found[tied], "other": nodes[root[tied]], "links": 0}),
            ]
        )

    found = stored(
        at_home.unionByName(partners).groupBy(*cell, "h", "b").applyInPandas(joined, "node long, other long, links long"),
        "found",
    )
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = (
        distinct.select("node", "label", "vector", "first", "copies")
        .join(counted, "node", "left")
        .join(tied, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    ids = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    known = stored(
        nodes.join(ids, "component").select(
            "label", "vector", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "known",
    )
    linked = salted_join(fit, known, ["label", "vector"], "copies", ["vec_id"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
