"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations.

Sources in code point order, null last, carry the weights 5, 2, 1 in turn and share SHARE of
all words; a target stops at twice its source's size and the excess goes to the others by
weight (one water level over all sources, found in closed form). A source's weight moves
linearly over training time, from (1 - a) to (1 + a) times its mean; a document copy that
stands at share y of its source's demand gets the time t at which the integral of the
schedule reaches y, and the mix is range-sorted by that time.

Inside a source documents stand in the order of the MD5 of their id. The words before a
document are summed in two steps, over slices of the order and inside a slice, so no task
sees a whole source. Whole documents are taken: every one as often as the target holds the
source, the first ones once more. The gap that is left, smaller than the document that did
not fit, is filled by falling size, each time with the largest documents that fit, until it
is smaller than any document left out; the smallest of those is added if that comes nearer.

Defined cases: a null text has size 0 and is never taken. Rows repeated under one id are
taken one by one; where they fill a slice, the slice is cut by text and number of the copy,
and equal rows are counted before they are dealt. Null ids count as empty text in the order.
Without any words all targets are 0. Only the named columns are read. Reruns give the same
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.storage import stored
from ticketloom.operators.scale import salted_join

WEIGHTS = (5, 2, 1)
SLOPES = (0.5, 0.0, -0.5)  # a by source, in turn: early or late in training
SHARE = 1.5
MOST_REPEATS = 2
SLICE_ROWS = 4_000  # documents in a slice of a source, on average


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Adds weight, slope and target to a table of sources (src, missing, source_size).

    With sources in the order of cap / weight, the level at the k-th is what the demand less
    the caps before it is worth per unit of the weights from it on; the level that holds is
    the first that does not pass its own source's cap. One row per source goes through here.
    """
    rank = F.row_number().over(Window.orderBy("missing", "src")) - 1
    turn = F.pmod(rank, F.lit(len(WEIGHTS)))
    weighed = sources.withColumns(
        {
            "weight": F.get(F.array(*[F.lit(w) for w in WEIGHTS]), turn),
            "slope": F.get(F.array(*[F.lit(s) for s in SLOPES]), turn),
            "cap": F.col("source_size") * MOST_REPEATS,
        }
    )
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "missing", "src")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = weighed.withColumns(
        {
            "place": F.row_number().over(filled),
            "level": (
                F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0))
            )
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        }
    )
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    return levels.withColumn(
        "target",
        F.least(
            F.col("cap").cast("double"), F.coalesce(F.min(holds).over(everything)["level"] * F.col("weight"), F.lit(0.0))
        ),
    ).drop("cap", "place", "level")


def _ordered(docs: DataFrame, id_col: str, text_col: str, source_col: str, more: dict[str, Column]) -> DataFrame:
    """Narrow rows with their source and the words before them in it, stored."""
    names = ["doc_id", "src", "missing", "size", "content", *more]
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("missing"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("content"),
        *[c.alias(name) for name, c in more.items()],
    )
    equal = stored(narrow.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "sizes")
    own = ["src", "missing"]
    sources = equal.groupBy(*own).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sources = stored(targets(sources).withColumn("slices", F.ceil(F.col("docs") / SLICE_ROWS)).coalesce(1), "sources")
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = salted_join(equal.withColumn("mark", mark), sources, own, "docs", ["mark", "content"]).withColumn(
        "slice", F.shiftright(_leading("mark") * F.col("slices"), 32).cast("int")
    )
    rows = stored(rows, "sliced")
    # Only a slice that repeats an id many times is cut further.
    fill = rows.groupBy(*own, "slice").agg(F.sum("n").alias("in_slice"), F.count(F.lit(1)).alias("rows_of"))
    parts = fill.withColumn("parts", F.ceil(F.col("in_slice") / (4 * SLICE_ROWS))).drop("in_slice")
    block = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {SLICE_ROWS}"))).alias("_block")
    first = F.col("_block") * SLICE_ROWS
    number = F.explode(F.sequence(first, F.least("n", first + SLICE_ROWS) - 1)).alias("_number")
    cut = salted_join(rows, parts, [*own, "slice"], "rows_of", ["mark", "content"]).select("*", block).select("*", number)
    tie = F.md5(F.concat_ws(" ", "content", "_number").cast("binary"))
    cut = cut.withColumn("tie", tie).withColumn("part", F.shiftright(_leading("tie") * F.col("parts"), 32).cast("int"))
    cut = stored(cut.drop("content", "n", "parts", "slices", "_block", "_number"), "parts")
    earlier = Window.partitionBy(*own).orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        cut.groupBy(*own, "slice", "part")
        .agg(F.sum("size").alias("words"))
        .select(*own, "slice", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy(*own, "slice", "part").orderBy("mark", "doc_id", "size", "tie", *more)
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stored(
        cut.join(bases, [*own, "slice", "part"]).withColumn("start", F.col("base") + running - F.col("size")), "ordered"
    )


def _leading(digest: str) -> Column:
    """The first 32 bits of a digest in hex."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _fills(rows: DataFrame) -> DataFrame:
    """src, missing, size, take, n: how many of the n documents of a size close the gap of a source.

    One fold over the sizes below twice the gap, from the largest. The gap is smaller than the
    document it was cut at, so a source has no more of these sizes than twice its longest text
    has words. Every size taken at least halves what is left of the gap or runs out of documents.
    """
    own = ["src", "missing"]
    sizes = (
        rows.where(~F.col("first") & (F.col("size") > 0) & (F.col("size") < F.col("gap") * 2))
        .groupBy(*own, "size")
        .agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap"))
    )
    held = sizes.groupBy(*own).agg(
        F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"), F.max("gap").alias("gap")
    )
    filled = F.expr(
        """aggregate(sizes, named_struct('room', gap, 'takes', cast(array() AS array<struct<size: bigint, take: bigint>>)),
             (acc, s) -> named_struct(
               'room', acc.room - s.size * least(s.n, floor(acc.room / s.size)),
               'takes', CASE WHEN s.size > acc.room THEN acc.takes
                 ELSE concat(acc.takes, array(named_struct('size', s.size, 'take', least(s.n, floor(acc.room / s.size))))) END))"""
    )
    nearest = F.expr(
        """array_min(transform(filter(sizes, s -> s.size > filled.room AND s.size < filled.room * 2
             AND NOT exists(filled.takes, t -> t.size = s.size AND t.take = s.n)), s -> s.size))"""
    )
    last = F.when(
        F.col("nearest").isNotNull(), F.array(F.struct(F.col("nearest").alias("size"), F.lit(1).cast("long").alias("take")))
    ).otherwise(F.array().cast("array<struct<size: bigint, take: bigint>>"))
    takes = (
        held.withColumn("filled", filled)
        .withColumn("nearest", nearest)
        .select(*own, F.explode(F.concat("filled.takes", last)).alias("t"))
        .groupBy(*own, F.col("t.size").alias("size"))
        .agg(F.sum("t.take").alias("take"))
    )
    return stored(takes.join(sizes.drop("gap"), [*own, "size"]).coalesce(1), "fills")


def _chosen(rows: DataFrame, fills: DataFrame) -> DataFrame:
    """src_of, missing_of, start_of of the first ``take`` documents of each size, counted over slices."""
    key = ["src", "missing", "size"]
    there = rows.where(~F.col("first") & (F.col("size") > 0)).select(*key, "slice", "part", "start", "mark")
    fitting = stored(salted_join(there, fills, key, "n", ["mark"]), "fitting")
    earlier = Window.partitionBy(*key).orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        fitting.groupBy(*key, "slice", "part", "take")
        .agg(F.count(F.lit(1)).alias("held"))
        .withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
        .where("before < take")
        .select(*key, "slice", "part", "before")
    )
    nth = F.row_number().over(Window.partitionBy(*key, "slice", "part").orderBy("start"))
    ranked = fitting.join(bases, [*key, "slice", "part"]).withColumn("nth", F.col("before") + nth)
    return ranked.where("nth <= take").select(
        F.col("src").alias("src_of"), F.col("missing").alias("missing_of"), F.col("start").alias("start_of")
    )


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    more: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken and positions (times of its copies) of every row."""
    more = more or {}
    ordered = _ordered(docs, id_col, text_col, source_col, more)
    own = ["src", "missing"]
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    rows = ordered.withColumn("whole", whole).withColumn("rest", rest)
    rows = rows.withColumn("first", (F.col("size") > 0) & (F.col("start") + F.col("size") <= F.col("rest")))
    gaps = rows.groupBy(*own).agg(
        F.count(F.lit(1)).alias("docs_of"),
        (F.max("rest") - F.coalesce(F.max(F.when(F.col("first"), F.col("start") + F.col("size"))), F.lit(0))).alias("gap"),
    )
    rows = stored(salted_join(rows, gaps, own, "docs_of", ["mark"]), "gaps")
    # Starts differ between documents that have words, so a start names its document.
    chosen = _chosen(rows, _fills(rows))
    same = (F.col("src") == F.col("src_of")) & (F.col("missing") == F.col("missing_of"))
    rows = rows.join(chosen, same & (F.col("start") == F.col("start_of")) & (F.col("size") > 0), "left")
    extra = F.col("start_of").isNotNull()
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("first") | extra).cast("int")).otherwise(0)
    middle = F.col("start") + F.col("size") / 2
    share = lambda k: F.least(
        F.lit(1.0),
        F.greatest(
            F.lit(0.0),
            F.when(extra & (k == F.col("whole")), F.col("target") - F.col("size") / 2).otherwise(
                k * F.col("source_size") + middle
            )
            / F.col("target"),
        ),
    )
    times = F.when(
        F.col("copies") > 0,
        F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: when(share(k), F.col("slope"))),
    ).otherwise(F.array().cast("array<double>"))
    # Before the select: a lambda in it would meet the rounded target under the same name.
    return rows.withColumn("copies", copies).withColumn("positions", times).select(
        "doc_id",
        "size",
        "source_size",
        decimals(F.col("target"), 6).alias("target"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "positions",
        *more,
    )


def when(share: Column, slope: Column) -> Column:
    """The time by which the schedule 1 - a + 2 a t has asked for this share of its demand."""
    start = F.lit(1.0) - slope
    return share * 2 / (start + F.sqrt(start * start + slope * 4 * share))


def decimals(number: Column, places: int) -> Column:
    """Rounded half up by arithmetic alone, which is the same in every engine."""
    scale = float(10**places)
    return F.floor(number * scale + 0.5) / scale


def mix(docs: DataFrame) -> DataFrame:
    """Every row with what the mix takes of it and its first position, in the order of training.

    The position is given at six decimals, as in the SQL twin; the order is that of the whole number.
    """
    planned = plan(docs).withColumn("_time", F.get("positions", F.lit(0)))
    return planned.orderBy(F.col("_time").asc_nulls_last(), "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", decimals(F.col("_time"), 6).alias("position")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, once for each copy taken, in the order of training.

    Texts meet their plan by a digest of id and text, which is never null, so that the choice of
    one row and the join share one shuffle of the texts; the sort is the other one. Equal rows
    are interchangeable: one of them is repeated for the copies of all.
    """
    digest = F.md5(
        F.concat(
            F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")),
            F.lit("\n"),
            F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("")),
        ).cast("binary")
    )
    planned = plan(docs, more={"_hash": digest}).where("taken > 0")
    times = planned.select(F.col("_hash").alias("_own"), F.col("positions").alias("_times"))
    one = Window.partitionBy("_own").orderBy("source")
    once = docs.withColumn("_own", digest).withColumn("_copy", F.row_number().over(one)).where("_copy = 1")
    return (
        once.join(times, "_own")
        .select(*[once[c] for c in docs.columns], F.explode("_times").alias("_time"))
        .orderBy("_time", "doc_id")
        .drop("_time")
    )
