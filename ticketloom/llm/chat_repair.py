"""Repair of conversation structure by a Viterbi search with survivor coalescence.

A well-formed conversation reads, by the initials of its roles, ``(s?(ua)+)?``. Its states are
START (nothing yet), S, U and A (the last role kept). Every turn is kept (0), given another
role (1) or deleted (2); an empty turn may be inserted anywhere (5); a truncated turn that is
not deleted costs 5 more, a blank or repeated one has to go. Of the cheapest edit sequences
the one whose initials (D, I, K, R) are least in ASCII order is taken.

Turns of a conversation are one ordered stream: Spark sorts them, spilling as it needs, and a
task reads them once. Every state keeps its cheapest survivor as a leaf of a tree of back
pointers with reference counts. A branch without survivors is freed; as soon as all survivors
share an ancestor the edits up to it are final, are given out and forgotten. What stays in
memory is the unresolved part only. Survivors of equal cost are told apart by all of their
unresolved edits, back to where they part. Two sequences of one cost and length in turns
differ before either ends, since each insertion costs, so comparing what is there is enough.
START and S would never die by themselves (they delete everything behind them); a survivor goes
when another one is cheaper by more than any rest can make up: the rest of a START survivor
costs at most 2 more from A (a system turn is deleted), that of an S survivor no more.

Repeated turns are found by Spark, not in the stream: the first of each (conversation, role,
text) is one aggregate, and these firsts are sorted in between the turns they stand for.

Defined cases: a null or empty role counts as one space, a null text as one space. Turns are
ordered by turn, null first; those that share one stand by role and SHA-256 of their text.
Rows repeated in full are separate turns, all but the first of them repeated ones. A null
conv_id is a conversation of its own. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ticketloom.llm.storage import light_batches

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, S, U, A = range(4)
_KEEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
_NEXT = {START: (U, "user"), S: (U, "user"), U: (A, "assistant"), A: (U, "user")}
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
MOVES = ("drop", "empty", "cut", "repeat", "user")  # what damage does, by remainder
OUT_ROWS = 4096


class Edit:
    """One edit of a survivor: a node of the tree, counted by what points back to it."""

    __slots__ = ("back", "letter", "role", "text", "depth", "refs", "ahead")

    def __init__(self, back: Edit | None, letter: str, role: str | None, text: str | None):
        self.back, self.letter, self.role, self.text = back, letter, role, text
        self.depth = back.depth + 1 if back else 0
        self.refs = 0  # survivors that end here and edits that follow
        self.ahead: list[Edit] = []
        if back:
            back.refs += 1
            back.ahead.append(self)


def _release(node: Edit) -> None:
    node.refs -= 1
    while not node.refs and node.back:
        back = node.back
        back.ahead.remove(node)
        back.refs -= 1
        node.back = None
        node = back


def _less(one: tuple[Edit, str], two: tuple[Edit, str]) -> bool:
    """Whether the unresolved edits of one path come before those of another of equal cost."""
    (a, last_a), (b, last_b) = one, two
    of_a, of_b = [last_a[::-1]], [last_b[::-1]]
    while a is not b:
        if a.depth >= b.depth:
            of_a.append(a.letter)
            a = a.back
        else:
            of_b.append(b.letter)
            b = b.back
    return "".join(of_a)[::-1] < "".join(of_b)[::-1]


class Repair:
    """The search over one conversation; ``emit`` takes final edits (letter, role, text) in order."""

    def __init__(self, emit: Callable[[str, str | None, str | None], None]):
        self.emit = emit
        self.root = Edit(None, "", None, None)
        self.root.refs = 1
        self.alive: dict[int, tuple[int, Edit]] = {START: (0, self.root)}
        self._insert()

    def _better(self, cost: int, path: tuple[Edit, str], other: tuple | None) -> bool:
        return other is None or cost < other[0] or (cost == other[0] and _less(path, other[1]))

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """One more turn: every survivor meets every edit of it."""
        found: dict[int, tuple] = {}
        more = TRUNCATED if truncated else 0

        def offer(state: int, cost: int, node: Edit, letter: str, new_role: str | None) -> None:
            if self._better(cost, (node, letter), found.get(state)):
                found[state] = (cost, (node, letter), new_role)

        for state, (cost, node) in self.alive.items():
            offer(state, cost + DELETE, node, "D", None)
            if must_go:
                continue
            kept = _KEEP.get((state, role[:1]))
            if kept is not None:
                offer(kept, cost + more, node, "K", role)
            after, new_role = _NEXT[state]
            if kept != after:
                offer(after, cost + REROLE + more, node, "R", new_role)
        alive = {}
        for state, (cost, (node, letter), new_role) in found.items():
            edit = Edit(node, letter, new_role, None if new_role is None else text)
            edit.refs += 1
            alive[state] = (cost, edit)
        for _, node in self.alive.values():
            _release(node)
        self.alive = alive
        self._insert()
        self._drop_hopeless()
        self._settle()

    def _insert(self) -> None:
        """Empty turns behind the last one, as far as they make a state cheaper."""
        for state, role, before in ((U, "user", (START, S, A)), (A, "assistant", (U,))):
            best = None
            for other in before:
                if other in self.alive:
                    cost, node = self.alive[other]
                    if self._better(cost + INSERT, (node, "I"), best):
                        best = (cost + INSERT, (node, "I"))
            if best is None:
                continue
            held = self.alive.get(state)
            if held is None or self._better(best[0], best[1], (held[0], (held[1], ""))):
                edit = Edit(best[1][0], "I", role, "")
                edit.refs += 1
                self.alive[state] = (best[0], edit)
                if held:
                    _release(held[1])

    def _drop_hopeless(self) -> None:
        least = self.alive[A][0]
        for state, slack in ((START, DELETE), (S, 0)):
            if state in self.alive and self.alive[state][0] > least + slack:
                _release(self.alive.pop(state)[1])

    def _settle(self) -> None:
        """Gives out what all survivors share."""
        while self.root.refs == 1 and self.root.ahead:
            edit = self.root.ahead.pop()
            edit.back = None
            self.root = edit
            self.emit(edit.letter, edit.role, edit.text)

    def end(self) -> int:
        """Gives out the rest of the best sequence and returns its cost."""
        cost, node = self.alive[A]
        if START in self.alive:
            other, first = self.alive[START]
            if other < cost or (other == cost and _less((first, ""), (node, ""))):
                cost, node = other, first
        rest = []
        while node is not self.root:
            rest.append(node)
            node = node.back
        for edit in reversed(rest):
            self.emit(edit.letter, edit.role, edit.text)
        return cost


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults by the CRC-32 of ``conv_id:turn``; dropped ones keep a row without role.

    conv_id, turn, place (role and text digest before the damage) and role and text after it.
    """
    remainder = F.pmod(F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")), F.lit(20))
    named = turns.select("conv_id", "turn", _spaced("role").alias("_role"), _spaced("text").alias("_text"))
    move = {name: F.col("_move") == i for i, name in enumerate(MOVES)}
    spoilt = named.withColumn("_move", remainder).select(
        "conv_id",
        "turn",
        F.struct(F.col("_role").alias("role"), F.unhex(F.sha2("_text", 256)).alias("digest")).alias("place"),
        F.when(move["drop"], F.lit(None)).when(move["user"], F.lit("user")).otherwise(F.col("_role")).alias("role"),
        F.when(move["drop"] | move["empty"], F.lit(""))
        .when(move["cut"], F.regexp_replace("_text", "[.!?]", ""))
        .otherwise(F.col("_text"))
        .alias("text"),
        F.when(move["repeat"], 2).otherwise(1).alias("_copies"),
    )
    return spoilt.select(
        "conv_id", "turn", "place", "role", "text", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    ).drop("_copy")


def undamaged(turns: DataFrame) -> DataFrame:
    """The turns as they are, in the form of ``damaged``."""
    return turns.select(
        "conv_id",
        "turn",
        F.struct(_spaced("role").alias("role"), F.unhex(F.sha2(_spaced("text"), 256)).alias("digest")).alias("place"),
        _spaced("role").alias("role"),
        _spaced("text").alias("text"),
    )


def _streams(rows: DataFrame) -> DataFrame:
    """Turns by conversation in order, each first of a role and text announced by a row before it."""
    firsts = (
        rows.where(F.col("role").isNotNull())
        .groupBy("conv_id", "role", F.sha2("text", 256).alias("_digest"))
        .agg(F.min(F.struct("turn", "place")).alias("_first"))
        .select("conv_id", F.col("_first.turn").alias("turn"), F.col("_first.place").alias("place"), F.lit(0).alias("kind"))
    )
    turns = rows.withColumn("kind", F.lit(1))
    both = firsts.withColumns({"role": F.lit(None).cast("string"), "text": F.lit("")}).select(turns.columns).union(turns)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "kind")


class _Chat:
    """What is known of one conversation while its turns come in."""

    def __init__(self, conv_id: object, edits: list | None):
        self.conv_id, self.edits = conv_id, edits
        self.turns, self.turn, self.before, self.first = 0, None, "", None
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.letters, self.hash, self.lines = bytearray(), hashlib.sha256(), 0
        self.repair = Repair(self.edit)

    def edit(self, letter: str, role: str | None, text: str | None) -> None:
        if self.edits is not None:
            self.edits.append((self.conv_id, len(self.letters), letter, role, text))
        self.letters += letter.encode()
        if role is not None:
            self.hash.update((b"\n" if self.lines else b"") + role.encode() + b":" + text.encode())
            self.lines += 1

    def add(self, turn: int | None, key: tuple, role: str, text: str) -> None:
        if turn is not None:
            self.gaps += 0 if self.turn in (None, turn) else turn - self.turn - 1
            self.turn = turn
        role = role or " "
        self.illegal += bool(self.turns) and self.before + role[:1] not in ("su", "ua", "au")
        self.before, self.turns = role[:1], self.turns + 1
        held = _BLANK.sub("", text[-64:]) or _BLANK.sub("", text)
        blank = not held
        repeated = not blank and self.first != key
        self.first = None  # the next one like it is a repetition
        truncated = not blank and not repeated and held[-1] not in ".!?"
        self.blank += blank
        self.duplicate += repeated
        self.truncated += truncated
        self.repair.turn(role, text, blank or repeated, truncated)

    def end(self) -> tuple:
        cost = self.repair.end() if self.turns else 0
        counts = (self.gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return self.conv_id, *counts, self.letters.decode() if self.turns else "", self.hash.hexdigest()


def _read(batches: Iterator[pa.RecordBatch], edits: list | None) -> Iterator[tuple | None]:
    """Feeds the stream to one conversation after the other; gives the audit of each, None between turns."""
    chat = None
    for batch in batches:
        ids, turns, places, roles, texts, kinds = (c.to_pylist() for c in batch.columns)
        for conv_id, turn, place, role, text, kind in zip(ids, turns, places, roles, texts, kinds):
            if chat is None or chat.conv_id != conv_id:
                if chat is not None:
                    yield chat.end()
                chat = _Chat(conv_id, edits)
            key = (turn, place["role"], place["digest"])
            if not kind:
                chat.first = key
            elif role is not None:
                chat.add(turn, key, role, text)
                yield None
    if chat is not None:
        yield chat.end()


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "place long, edit string, role string, text string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """One row a conversation: faults, the cost and initials of its edits, the digest of what is left."""
    light_batches(rows.sparkSession)
    form = StructType([StructField("conv_id", rows.schema["conv_id"].dataType)] + StructType.fromDDL(AUDIT).fields)
    schema = to_arrow_schema(form)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for done in _read(batches, None):
            if done is not None:
                waiting.append(done)
            if len(waiting) >= OUT_ROWS:
                yield _batch(waiting, schema)
                waiting = []
        if waiting:
            yield _batch(waiting, schema)

    return _streams(rows).mapInArrow(read, form)


def repaired(rows: DataFrame) -> DataFrame:
    """Every edit of every conversation in order: conv_id, place, edit and the role and text it leaves (null: none)."""
    light_batches(rows.sparkSession)
    form = StructType([StructField("conv_id", rows.schema["conv_id"].dataType)] + StructType.fromDDL(EDITS).fields)
    schema = to_arrow_schema(form)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits: list[tuple] = []
        for _ in _read(batches, edits):
            if len(edits) >= OUT_ROWS:
                yield _batch(edits, schema)
                edits.clear()
        if edits:
            yield _batch(edits, schema)

    return _streams(rows).mapInArrow(read, form)
