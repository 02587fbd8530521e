"""Tool calls of chats: linked to their results, ordered, validated and serialised.

Calls and results meet in one hash join by conversation and call id. A call may name calls
that it follows; its level is the longest such chain below it, found level by level, and
(conversation, level, turn, id) is a topological order, by which the rows are range-sorted.
Arguments are checked against the JSON schema of their tool, and every call becomes one line
of canonical JSON: keys in code point order, no spaces, numbers in their shortest form.

Defined cases. ``status``: ``linked``; ``pending``, a call without a result; ``orphan``, a
result without a call (no level, name or record); ``cyclic``, a call that follows itself
through others (no level). Of calls that repeat an id in a conversation the first turn stays,
of results likewise; ``n_calls`` and ``n_results`` tell how many there were. Null ids never
match: such a call is pending, such a result an orphan. Names in ``after`` that are no calls
are ignored. Arguments that are null, no JSON, repeat a key, hold NaN or half of a surrogate
pair (the record then has null for them) are invalid, as is an unknown tool; ``errors`` says why. Empty tables give an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.storage import stored

CALL = ["conv_id", "call_id"]
CHECKED = "valid boolean, errors string, record string"
TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v),
}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value under a schema: type, enum, bounds, lengths, properties, items."""
    kinds = schema.get("type")
    if kinds and not any(TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if TYPES["number"](value):
        if value < schema.get("minimum", value):
            found.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            found.append(f"{at}: above maximum")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        found.append(f"{at}: bad length")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{name}: missing" for name in sorted(schema.get("required", [])) if name not in value]
        for name in sorted(value):
            if name in known:
                found += problems(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{name}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += problems(item, schema["items"], f"{at}[{i}]")
    return found


def parse(text: str):
    """The value of a JSON text; ValueError for repeated keys, NaN and infinite numbers too."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(f"{name} is no number")

    def number(digits):
        value = float(digits)
        if value in (float("inf"), float("-inf")):
            raise ValueError("number out of range")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse, parse_float=number)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def check(arguments: str | None, schema: dict | None) -> tuple[list[str], object]:
    """Errors of a call's arguments, and their value."""
    try:
        value = parse(arguments) if arguments is not None else None
    except RecursionError:
        return ["arguments: too deep"], None
    except ValueError:
        return ["arguments: not JSON"], None
    if arguments is None:
        return ["arguments: missing"], None
    try:
        canonical(value).encode()
    except UnicodeEncodeError:
        return ["arguments: lone surrogate"], None
    if schema is None:
        return ["name: unknown tool"], value
    return problems(value, schema), value


def _jumped(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of calls that follow one call each, by pointer jumping.

    ``single`` has (conv_id, call_id, before). Returns, for each call whose chain ends, the call
    (conv_id, call_id, anchor, steps) it ends at, which follows none or several; calls that lead
    into a cycle of such calls are left out. The number of rounds grows with the logarithm of the
    longest chain: a round doubles the steps, and one that ends no chain was the last.
    """
    done, open_ = None, stored(single.select(*CALL, F.col("before").alias("anchor"), F.lit(1).alias("steps")), "chains")
    known = open_.select("conv_id", F.col("call_id").alias("anchor"))
    while True:
        ended = stored(open_.join(known, ["conv_id", "anchor"], "left_anti").select(*CALL, "anchor", "steps"), "chains")
        if ended.isEmpty():
            return done if done is not None else ended
        done = ended if done is None else done.unionByName(ended)
        rest = open_.join(ended.select(*CALL), CALL, "left_anti")
        # Calls half-way that have ended carry on with their end, others with where they are.
        ahead = done.unionByName(rest).select(
            "conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("_next"), F.col("steps").alias("_more")
        )
        open_ = stored(
            rest.join(ahead, ["conv_id", "anchor"]).select(
                *CALL, F.col("_next").alias("anchor"), (F.col("steps") + F.col("_more")).alias("steps")
            ),
            "chains",
        )


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call that is in no cycle and follows none.

    Chains of calls with one predecessor are shortened to one step first; the rounds over levels
    that remain are those of calls that follow several, and read what the last round found only.
    """
    edges = (
        calls.select(*CALL, F.explode("after").alias("before"))
        .distinct()
        .join(calls.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"])
    )
    needs = F.count(F.lit(1)).over(Window.partitionBy(*CALL))
    edges = stored(edges.withColumn("needs", needs), "edges")
    chains = stored(_jumped(edges.where("needs = 1").select(*CALL, "before")), "chains")
    free = calls.select(*CALL).join(edges.select(*CALL).distinct(), CALL, "left_anti").withColumn("level", F.lit(0))
    # Edges of calls that follow several, each led back to the end of its predecessor's chain.
    several = edges.where("needs > 1")
    ends = chains.select("conv_id", F.col("call_id").alias("before"), "anchor", "steps")
    single = edges.where("needs = 1").select("conv_id", F.col("call_id").alias("before"))
    direct = several.join(single, ["conv_id", "before"], "left_anti")
    led = several.join(ends, ["conv_id", "before"]).select(*CALL, "anchor", (F.col("steps") + 1).alias("steps"), "needs")
    waiting = stored(
        led.unionByName(direct.select(*CALL, F.col("before").alias("anchor"), F.lit(1).alias("steps"), "needs")), "waiting"
    )
    known = new = stored(free, "levels")
    met = None  # what waiting calls have heard from their predecessors so far
    while not new.isEmpty():
        heard = waiting.join(new.withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"]).select(
            *CALL, "needs", F.lit(1).alias("met"), (F.col("level") + F.col("steps")).alias("level")
        )
        heard = heard if met is None else met.unionByName(heard)
        summed = heard.groupBy(*CALL, "needs").agg(F.sum("met").cast("int").alias("met"), F.max("level").alias("level"))
        met = stored(summed, "met")
        new = stored(met.where("met = needs").select(*CALL, "level"), "levels")
        met = met.where("met < needs")
        known = known.unionByName(new)
    ended = chains.join(known.withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"])
    return known.unionByName(ended.select(*CALL, (F.col("level") + F.col("steps")).alias("level")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call and each result without one.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON), after (ids of calls it
    follows); ``results``: conv_id, turn, call_id, content. ``schemas`` is a parameter of the
    job, a JSON schema for each tool.
    """
    named = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    identified = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    body = F.struct("turn", "name", "arguments", "after")
    merged = (
        named.where(identified)
        .groupBy(*CALL)
        .agg(F.min(body).alias("call"), F.count(F.lit(1)).alias("n_calls"))
        .unionByName(named.where(~identified).select(*CALL, body.alias("call"), F.lit(1).cast("long").alias("n_calls")))
    )
    merged = stored(merged.select(*CALL, "call.*", "n_calls"), "calls")
    own = results.select(*CALL, F.struct("turn", "content").alias("result"))
    answers = (
        own.where(identified)
        .groupBy(*CALL)
        .agg(F.min("result").alias("result"), F.count(F.lit(1)).alias("n_results"))
        .unionByName(own.where(~identified).select(*CALL, "result", F.lit(1).cast("long").alias("n_results")))
    )
    ordered = levels(merged.where(identified).select(*CALL, "after"))
    linked = (
        merged.withColumn("is_call", F.lit(True))
        .join(ordered, CALL, "left")
        .withColumn("level", F.when(identified, F.col("level")).otherwise(0))
        .join(answers, CALL, "full")
    )
    status = (
        F.when(F.col("is_call").isNull(), "orphan")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("n_results").isNull(), "pending")
        .otherwise("linked")
    )
    rows = linked.select(
        *CALL, F.coalesce("turn", "result.turn").alias("turn"), "name", "level", status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        "arguments", "after", F.col("result.content").alias("content"),
    )

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, records = [], [], []
            for row in batch.to_pylist():
                if row["status"] == "orphan":
                    found, record = ["call: missing"], None
                else:
                    found, value = check(row["arguments"], schemas.get(row["name"]))
                    record = canonical(
                        {
                            "after": sorted(a for a in row["after"] or [] if a is not None),
                            "arguments": value,
                            "id": row["call_id"],
                            "name": row["name"],
                            "result": row["content"],
                        }
                    )
                valid.append(not found)
                errors.append("; ".join(found))
                records.append(record)
            kept = batch.select([f.name for f in batch.schema if f.name not in ("arguments", "after", "content")])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(records, pa.string())],
                names=[*kept.schema.names, "valid", "errors", "record"],
            )

    kinds = [f"{n} {k}" for n, k in rows.dtypes if n not in ("arguments", "after", "content")]
    # Stored, so that the sort, which reads its input twice, checks no call again.
    found = stored(rows.mapInArrow(checked, f"{', '.join(kinds)}, {CHECKED}"), "checked")
    return found.orderBy("conv_id", "level", "turn", "call_id")


#: Tools of the registered query.
TOOLS = {
    "search": {
        "type": "object",
        "required": ["limit", "text"],
        "additionalProperties": False,
        "properties": {
            "text": {"type": "string", "minLength": 1},
            "limit": {"type": "integer", "minimum": 1, "maximum": 50},
        },
    },
    "summarise": {
        "type": "object",
        "required": ["style", "text"],
        "properties": {"text": {"type": "string"}, "style": {"enum": ["long", "short"]}},
    },
    "translate": {
        "type": "object",
        "required": ["into", "text"],
        "properties": {"text": {"type": "string", "maxLength": 1000}, "into": {"type": ["string", "null"]}},
    },
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats: what a chat looks like when every assistant turn is a
    call of a tool, taken by its length, that follows the call two turns before, and the user
    turn behind it brings the result."""
    length = F.length("text")
    call_id = lambda turn: F.concat_ws("-", F.lit("call"), "conv_id", turn)
    spoken = turns.where("role = 'assistant' and text is not null and conv_id is not null and turn is not null")
    calls = spoken.select(
        "conv_id",
        "turn",
        call_id(F.col("turn")).alias("call_id"),
        F.get(F.array(*[F.lit(t) for t in sorted(TOOLS)]), F.pmod(length, F.lit(len(TOOLS)))).alias("name"),
        F.to_json(
            F.struct(
                "text",
                F.when(length % 3 == 0, length % 60).alias("limit"),
                F.when(length % 3 == 1, F.when(length % 2 == 0, "long").otherwise("brief")).alias("style"),
                F.when(length % 3 == 2, F.substring("text", 1, 2)).alias("into"),
            )
        ).alias("arguments"),
        F.array(call_id(F.col("turn") - 2)).alias("after"),
    )
    heard = turns.where("role = 'user' and turn > 0 and conv_id is not null")
    results = heard.select("conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
