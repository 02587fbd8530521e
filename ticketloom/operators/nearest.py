"""Exact top-k by inner product between two tables of vectors.

Both sides are cut into blocks, whatever their size, and every block of items meets every
chunk of queries in a task of its own.

* Plain vectors: the block is parted into cells of vectors that are alike, with a centre c and
  a radius r, so that q.x <= q.c + |q| r for any member. A query visits cells by falling bound
  and leaves the rest out as soon as the bound falls below its k-th score.
* Sparse vectors, ``array<struct<slot, weight>>``: the entries of the block are put in the order
  of their slots, once. Slots that are frequent on both sides become rows of a matrix and go
  through a product; for the others a query adds up the entries of its own slots.

Only the k best per query of a block leave the task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.scale import salted_join, stored, top_per_group

# The task functions travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DECIMALS = 6
BLOCK_ROWS = 32_768
CHUNK_ROWS = 65_536
BLOCK_ENTRIES = 1 << 22  # numbers that a block holds at most, unless one vector has more
CHUNK_ENTRIES = 1 << 21
LEAST_QUERIES = 2_048  # a chunk is not made smaller for the sake of more tasks
CELL_ROWS = 256
TILE_QUERIES = 256
ENTRY_COST = 1024  # numbers of a matrix product that take as long as an entry that is added up by its place
SAMPLE = 8  # for each of the k, so many columns of items give a lower bound of the k-th score
CROWD = 64  # times k candidates, from which on they are cut before they are sorted
TURN_QUERIES = 16_384  # queries of a chunk that search a block at the same time


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix."""
    if len(vectors) == 0:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), -1)


class Plain:
    """Vectors of one length."""

    def __init__(self, vectors: pa.Array):
        self.rows = _matrix(vectors)
        self.count = len(self.rows)

    def cells(self, n: int) -> np.ndarray:
        """A cell for every row: the nearest of n rows taken at even steps."""
        pivots = self.rows[np.linspace(0, len(self.rows) - 1, n).astype(np.int64)]
        gaps = np.nan_to_num((pivots * pivots).sum(1) / 2 - self.rows @ pivots.T, nan=np.inf)
        return gaps.argmin(axis=1)

    def bounds(self, queries: Plain, cells: list[np.ndarray]) -> np.ndarray:
        """For each query and cell, what no score of a member exceeds."""
        centres = np.stack([self.rows[c].mean(axis=0) for c in cells])
        radii = np.array([np.sqrt(((self.rows[c] - m) ** 2).sum(1)).max() for c, m in zip(cells, centres)])
        lengths = np.sqrt((queries.rows * queries.rows).sum(1))
        found = queries.rows @ centres.T + lengths[:, None] * radii[None, :]
        return np.where(np.isnan(found), np.inf, found)

    def opened(self, members: np.ndarray) -> np.ndarray:
        """A cell as its queries read it."""
        return self.rows[members].T

    def scores(self, queries: Plain, asking: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return queries.rows[asking] @ cell


class Sparse:
    """Vectors as lists of slots and their weights."""

    def __init__(self, vectors: pa.Array):
        entries = vectors.flatten()
        self.slots = entries.field("slot").to_numpy(zero_copy_only=False).astype(np.int64)
        self.weights = entries.field("weight").to_numpy(zero_copy_only=False).astype(np.float64)
        self.ends = np.concatenate(([0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
        self.count = len(vectors)


class Postings:
    """The entries of a block of sparse vectors by slot; slots that are frequent on both sides as whole rows."""

    def __init__(self, items: Sparse, place_of: np.ndarray, queries: list[Sparse]):
        self.count = items.count
        of = np.repeat(place_of, np.diff(items.ends))
        by_slot = np.argsort(items.slots, kind="stable")
        self.known, starts = np.unique(items.slots[by_slot], return_index=True)
        self.places, self.weights = of[by_slot], items.weights[by_slot]
        self.ends = np.append(starts, len(by_slot))
        asked = sum((np.bincount(self.columns(part)[0], minlength=len(self.known)) for part in queries), np.zeros(len(self.known)))
        added = asked * np.diff(self.ends) * ENTRY_COST
        frequent = np.flatnonzero(added >= sum(part.count for part in queries) * self.count)
        frequent = frequent[np.argsort(-added[frequent], kind="stable")][: BLOCK_ENTRIES // max(self.count, 1)]
        self.rows = np.zeros((len(frequent), self.count))
        self.row_of = np.full(len(self.known), -1)
        self.row_of[frequent] = np.arange(len(frequent))
        for row, column in enumerate(frequent):
            there = slice(self.ends[column], self.ends[column + 1])
            self.rows[row, self.places[there]] = self.weights[there]

    def columns(self, queries: Sparse) -> tuple[np.ndarray, np.ndarray]:
        """Of the entries of the queries whose slot is known, the slot's number, and which entries these are."""
        column = np.searchsorted(self.known, queries.slots)
        column[column == len(self.known)] = 0
        held = np.flatnonzero(self.known[column] == queries.slots) if len(self.known) else np.zeros(0, np.int64)
        return column[held], held

    def scores(self, queries: Sparse) -> Iterator[tuple[int, np.ndarray]]:
        """Products of all vectors with a tile of queries, and the number of its first one."""
        column, held = self.columns(queries)
        ends = np.searchsorted(held, queries.ends)
        of, row, weight = np.repeat(np.arange(queries.count), np.diff(ends)), self.row_of[column], queries.weights[held]
        first, last = self.ends[column], self.ends[column + 1]
        size = max(1, min(TILE_QUERIES, BLOCK_ENTRIES // max(self.count, 1)))
        for start in range(0, queries.count, size):
            end = min(start + size, queries.count)
            own = slice(ends[start], ends[end])
            whole = row[own] >= 0
            dense = np.zeros((end - start, len(self.rows)))
            dense[of[own][whole] - start, row[own][whole]] = weight[own][whole]
            tile = dense @ self.rows
            rest = ends[start] + np.flatnonzero(~whole)
            sizes = last[rest] - first[rest]
            at = np.arange(sizes.sum()) + np.repeat(first[rest] - (np.cumsum(sizes) - sizes), sizes)
            places = self.places[at] + np.repeat((of[rest] - start) * self.count, sizes)
            np.add.at(tile.reshape(-1), places, self.weights[at] * np.repeat(weight[rest], sizes))
            yield start, tile


def _postings_best(
    queries: list[Sparse], items: Sparse, ids: np.ndarray, k: int, floor: float
) -> tuple[tuple[np.ndarray, ...], int, int]:
    """As _block_best, for sparse vectors: a query adds up the entries of its slots, and a block is one cell."""
    by_id = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], ids[by_id][1:] != ids[by_id][:-1])))
    place_of = np.empty(len(by_id), np.int64)
    place_of[by_id] = np.arange(len(by_id))
    block = Postings(items, place_of, queries)
    runs = max(1, len(heads) // (SAMPLE * k))
    whole = len(heads) // runs * runs
    lowest = np.round(floor, DECIMALS) - 10.0**-DECIMALS
    found, before = [], 0
    for part in queries:
        for start, tile in block.scores(part):
            np.fmax(tile, -np.inf, out=tile)
            if len(heads) < len(by_id):
                tile = np.maximum.reduceat(tile, heads, axis=1)
            least = np.full(len(tile), lowest)
            if runs > 1:  # the best of every column of runs: k items are no worse than the k-th of these
                tops = tile[:, :whole].reshape(len(tile), runs, -1).max(axis=1)
                least = np.maximum(least, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] - 10.0**-DECIMALS)
            near = tile >= least[:, None]
            for query in np.flatnonzero(np.count_nonzero(near, axis=1) > CROWD * k):
                near[query] = _first_places(np.round(tile[query], DECIMALS) + 0.0, k)
            row, place = _there(near)
            score = tile[row, place]
            value = np.round(score, DECIMALS) + 0.0
            best, _ = _first_k(row, value, k, place)
            best = best[(value[best] >= lowest) & (score[best] > -np.inf)]
            found.append((before + start + row[best], place[best], score[best]))
        before += part.count
    row, place, score = (np.concatenate(p) for p in zip(*found))
    return (row, ids[by_id[heads[place]]], score), before, before


def _there(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As nonzero, which takes longer over two dimensions than over one."""
    return np.divmod(np.flatnonzero(table), max(table.shape[1], 1))


def _first_places(values: np.ndarray, k: int) -> np.ndarray:
    """Whether a value is one of the k highest, the first ones among equal values."""
    least = np.partition(values, len(values) - k)[len(values) - k]
    chosen = values > least
    chosen[np.flatnonzero(values == least)[: k - chosen.sum()]] = True
    return chosen


def _block_best(
    queries: list, items, ids: np.ndarray, k: int, floor: float = -np.inf
) -> tuple[tuple[np.ndarray, ...], int, int]:
    """k best ids per query row (query rows, ids, scores), how many cells were read, and of how many.

    Rows that carry one id stand together and count as one item, with its best score. Scores
    are compared at six decimals and equal ones are decided by id; they are given out whole.
    An item whose score is not a number is not ranked. The queries come in parts, which search
    the cells of the block one after the other.
    """
    if k == 0 or not queries or not len(ids):
        return (np.zeros(0, np.int64), ids[:0], np.zeros(0)), 0, 0
    if isinstance(items, Sparse):
        return _postings_best(queries, items, ids, k, floor)
    by_id = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], ids[by_id][1:] != ids[by_id][:-1])))
    cell_of_head = items.cells(-(-len(ids) // CELL_ROWS))[by_id[heads]]
    cell_of = np.repeat(cell_of_head, np.diff(np.append(heads, len(ids))))
    members = [np.flatnonzero(cell_of == c) for c in np.unique(cell_of)]  # places in the order of ids
    cells = [by_id[m] for m in members]
    firsts = [np.flatnonzero(np.concatenate(([True], ids[c][1:] != ids[c][:-1]))) for c in cells]
    opened = [items.opened(c) for c in cells]
    found, read, before = [], 0, 0
    for part in queries:
        (row, place, score), own_read = _part_best(part, items, cells, opened, firsts, members, k, floor)
        found.append((row + before, place, score))
        read, before = read + own_read, before + part.count
    row, place, score = (np.concatenate(p) for p in zip(*found))
    return (row, ids[by_id[place]], score), read, before * len(members)


def _part_best(
    queries: Plain,
    items: Plain,
    cells: list[np.ndarray],
    opened: list[np.ndarray],
    firsts: list[np.ndarray],
    members: list[np.ndarray],
    k: int,
    floor: float,
) -> tuple[tuple[np.ndarray, ...], int]:
    """k best places per query row of one part (rows, places, scores), and how many cells were read."""
    n_queries = queries.count
    bounds = items.bounds(queries, cells)
    order = np.argsort(-bounds, axis=1, kind="stable")
    # The best scores so far, rounded, falling; nothing below the floor is looked for.
    least = np.full((n_queries, k), np.round(floor, DECIMALS) - 10.0**-DECIMALS)
    found, read = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    for turn in range(len(members)):
        cell = order[:, turn]
        open_ = np.flatnonzero(bounds[np.arange(n_queries), cell] >= least[:, -1] - 10.0**-DECIMALS)
        if not len(open_):
            break
        for c in np.unique(cell[open_]):
            asking = open_[cell[open_] == c]
            for at in range(0, len(asking), TILE_QUERIES):
                tile = asking[at : at + TILE_QUERIES]
                found.append(_improved(least, tile, items.scores(queries, tile, opened[c]), members[c], firsts[c]))
            read += len(asking)
    row, place, score = (np.concatenate(p) for p in zip(*found))
    kept = np.round(score, DECIMALS) + 0.0 >= least[row, -1]
    row, place, score = row[kept], place[kept], score[kept]
    best, _ = _first_k(row, np.round(score, DECIMALS) + 0.0, k, place)
    return (row[best], place[best], score[best]), read


def _first_k(row: np.ndarray, value: np.ndarray, k: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the k highest of their row, by falling value and rising place, and their ranks."""
    falling = np.lexsort((-value, row) if place is None else (place, -value, row))
    held = np.bincount(row)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
    return falling[rank < k], rank[rank < k]


def _improved(
    least: np.ndarray, tile: np.ndarray, scores: np.ndarray, places: np.ndarray, firsts: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Scores of a tile that may be among the k best (rows, places, scores); ``least`` is brought up to them.

    Columns from one of ``firsts`` to the next are one item, which is given out by its first place.
    Only scores near the k-th or above are looked at as items, rounded and sorted: after the first
    cells these are few. A score that is not a number is never near.
    """
    k = least.shape[1]
    near = lambda: _there(scores >= least[tile, -1:] - 10.0**-DECIMALS)
    rows, columns = near()
    crowded = len(rows) > k * len(tile)
    if crowded:
        np.fmax(scores, -np.inf, out=scores)
        if len(firsts) < len(places):
            scores = np.maximum.reduceat(scores, firsts, axis=1)
            places = places[firsts]
        rows, columns = near()
    score = scores[rows, columns]
    finite = score > -np.inf
    rows, columns, score = rows[finite], columns[finite], score[finite]
    if not crowded and len(firsts) < len(places) and len(rows):
        item = np.searchsorted(firsts, columns, side="right") - 1
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (item[1:] != item[:-1]))))
        score = np.maximum.reduceat(score, starts)
        rows, columns = rows[starts], firsts[item[starts]]
    rounded = np.round(score, DECIMALS) + 0.0
    if crowded:
        whole = np.round(scores, DECIMALS) + 0.0
        both = np.concatenate((least[tile], whole), axis=1)
        least[tile] = -np.sort(-both, axis=1)[:, :k] if both.shape[1] <= 2 * k else -np.sort(
            np.partition(-both, k - 1, axis=1)[:, :k], axis=1
        )
    elif len(rows):
        changed, own = np.unique(rows, return_inverse=True)
        values = np.concatenate((least[tile[changed]].ravel(), rounded))
        of = np.concatenate((np.repeat(np.arange(len(changed)), k), own))
        best, rank = _first_k(of, values, k)
        least[tile[changed[of[best]]], rank] = values[best]
    kept = rounded >= least[tile[rows], -1]
    return tile[rows[kept]], places[columns[kept]], score[kept]


def _sides(df: DataFrame, id_col: str, side: str, grouped: bool) -> DataFrame:
    groups = [F.col("groups").alias(f"{side}_groups")] if grouped else []
    usable = df.where(F.col("embedding").isNotNull())
    return usable.select(
        F.col(id_col).alias(f"{side}_id"), F.col("embedding").alias(f"{side}_vector"), *groups
    )


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _searched(
    queries: pa.Table, items: pa.Table, k: int, floor: float = -np.inf
) -> tuple[tuple[np.ndarray, ...], int, int]:
    vectors = _one(items.column("item_vector"))
    form = Sparse if pa.types.is_struct(vectors.type.value_type) else Plain
    asked = _one(queries.column("query_vector"))
    parts = [form(asked.slice(at, TURN_QUERIES)) for at in range(0, len(asked), TURN_QUERIES)]
    return _block_best(parts, form(vectors), items.column("item_id").to_pandas().to_numpy(), k, floor)


def top_matches(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    item_id: str = "item_id",
    grouped: bool = False,
    floor: float = float("-inf"),
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """k best items for every query: ``query_id, item_id, score, rank``.

    Both tables have their id and ``embedding``, plain or sparse. With ``grouped`` they also
    have ``groups``, an array, and an item is eligible if it shares a group with the query.
    Scores are whole; those that agree to six decimals are ordered by id. An item or query id
    that several rows carry is one item or query, with the best score of its rows. Items that a
    later step drops by a ``floor`` under the scores need not be found; those near it still are.
    """
    asked = _sides(queries, query_id, "query", grouped)
    offered = _sides(items, item_id, "item", grouped)
    id_types = (asked.schema["query_id"].dataType, offered.schema["item_id"].dataType)
    result = f"query_id {id_types[0].simpleString()}, item_id {id_types[1].simpleString()}, score double"

    def search(queries: pa.Table, items: pa.Table) -> pa.Table:
        schema = pa.schema(
            [
                ("query_id", queries.schema.field("query_id").type),
                ("item_id", items.schema.field("item_id").type),
                ("score", pa.float64()),
            ]
        )
        if queries.num_rows == 0 or items.num_rows == 0:
            return schema.empty_table()
        (row, item, score), _, _ = _searched(queries, items, k, floor)
        ids = queries.column("query_id").to_pandas().to_numpy()[row]
        frame = pd.DataFrame({"query_id": ids, "item_id": item, "score": score})
        return pa.Table.from_pandas(frame, schema=schema, preserve_index=False)

    partial = _block_pairs(asked, offered, grouped, block_rows, chunk_rows).applyInArrow(search, result)
    # One shuffle by query serves both steps; a query has k rows for each block it met.
    best = partial.repartition("query_id").groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    ranked = top_per_group(best, ["query_id"], [F.round("score", DECIMALS).desc(), F.col("item_id")], k)
    return ranked.select(
        F.col("query_id").alias(query_id), F.col("item_id").alias(item_id), "score", "rank"
    )


def cells_read(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    item_id: str = "item_id",
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """How many pairs of query and cell a search reads, and how many there are: ``read, pairs``."""
    asked, offered = _sides(queries, query_id, "query", False), _sides(items, item_id, "item", False)

    def count(queries: pa.Table, items: pa.Table) -> pa.Table:
        both = queries.num_rows and items.num_rows
        _, read, pairs = _searched(queries, items, k) if both else ((), 0, 0)
        return pa.table({"read": pa.array([read], pa.int64()), "pairs": pa.array([pairs], pa.int64())})

    counted = _block_pairs(asked, offered, False, block_rows, chunk_rows).applyInArrow(count, "read long, pairs long")
    return counted.agg(F.sum("read").alias("read"), F.sum("pairs").alias("pairs"))


def _block_pairs(asked: DataFrame, offered: DataFrame, grouped: bool, block_rows: int, chunk_rows: int):
    """Every block of items next to every chunk of queries of the same group.

    A group's number of blocks and chunks follows from its counted size, so a group
    that holds a third of all items is cut into as many tasks as it needs. A task holds
    at most about ``block_rows`` items and ``chunk_rows`` queries, ``BLOCK_ENTRIES`` numbers
    of the one and ``CHUNK_ENTRIES`` of the other: a side goes through the shuffle once for each part of the other, so parts are
    as large as a task can hold, and short queries make few of them.
    """
    parts = lambda n, entries, rows, most: F.greatest(
        F.ceil(n / rows), F.ceil(entries / most), F.lit(1)
    ).cast("int")
    size = lambda vector: F.sum(F.size(vector).cast("long"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if grouped:
        asked = asked.withColumn("group", F.explode(F.array_distinct("query_groups"))).drop("query_groups")
        offered = offered.withColumn("group", F.explode(F.array_distinct("item_groups"))).drop("item_groups")
        counts = offered.groupBy("group").agg(F.count(F.lit(1)).alias("n_items"), size("item_vector").alias("item_size"))
        counts = counts.join(
            asked.groupBy("group").agg(F.count(F.lit(1)).alias("n_queries"), size("query_vector").alias("query_size")), "group"
        )
        plan = stored(
            counts.select(
                "group", "n_items", "n_queries",
                parts(F.col("n_items"), F.col("item_size"), block_rows, BLOCK_ENTRIES).alias("n_blocks"),
                parts(F.col("n_queries"), F.col("query_size"), chunk_rows, CHUNK_ENTRIES).alias("n_chunks"),
            )
        )
        sizes = ["group", "n_blocks", "n_chunks"]
        asked = salted_join(asked, plan.select(*sizes, "n_queries"), ["group"], "n_queries", ["query_id"])
        offered = salted_join(offered, plan.select(*sizes, "n_items"), ["group"], "n_items", ["item_id"])
    else:
        n_parts = lambda n, entries, rows, most: max(1, math.ceil(n / rows), math.ceil(entries / most))
        held = lambda df, vector: df.agg(F.count(F.lit(1)), F.coalesce(size(vector), F.lit(0))).first()
        (n_items, item_size), (n_queries, query_size) = held(offered, "item_vector"), held(asked, "query_vector")
        n_blocks = n_parts(n_items, item_size, block_rows, BLOCK_ENTRIES)
        # Two tasks for every core, as long as a chunk is worth its way through the shuffle.
        wanted = math.ceil(2 * asked.sparkSession.sparkContext.defaultParallelism / n_blocks)
        n_chunks = max(n_parts(n_queries, query_size, chunk_rows, CHUNK_ENTRIES), min(n_queries // LEAST_QUERIES, wanted))
        asked, offered = (side.withColumns({"n_blocks": F.lit(n_blocks), "n_chunks": F.lit(n_chunks)}) for side in (asked, offered))
        asked, offered = (side.withColumn("group", F.lit("all")) for side in (asked, offered))
    asked = (
        asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("n_chunks")).cast("int"))
        .withColumn("block", upto("n_blocks"))
        .drop("n_blocks", "n_chunks")
    )
    offered = (
        offered.withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("n_blocks")).cast("int"))
        .withColumn("chunk", upto("n_chunks"))
        .drop("n_blocks", "n_chunks")
    )
    keys = ["group", "block", "chunk"]
    return asked.groupBy(*keys).cogroup(offered.groupBy(*keys))
