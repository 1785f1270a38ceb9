"""Chat formatting: tool-call linking.

Calls and results are read from messages, hash-joined by (conversation, identifier), put into topological order, checked against the
JSON schemas of their functions, and written as canonical JSON: keys sorted, no white space, characters as they are.

A message whose text is a JSON object with ``tool_calls`` makes calls: {"id", "name", "arguments" (object or JSON text), "after" (the
identifier of the call whose result it needs, if any, or a list of them)}. One with ``tool_call_id`` is the result of that call, with ``content``. In
plain chats each user turn is a call of ``reply`` and the following assistant turn its result; each needs the user turn before it.

The order is each call's depth: the longest chain of calls that must come before it. Pointer doubling finds it along chains, so the
rounds grow with the logarithm of the longest, and calls that need several others are resolved level by level. No conversation is ever
gathered in one task, not even one with a third of all messages. Results follow their call in the same row. Each round's table is
written to the shared folder. ``transcripts`` writes conversations out in that order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SCHEMAS: dict[str, dict] = {
    "reply": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}}, "required": ["text"], "additionalProperties": False},
}

TYPES: dict[str, Any] = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


LONE = re.compile("[\ud800-\udfff]")


def plain(text: str) -> str:
    """Half a surrogate pair can't be stored; it is written as its JSON escape."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    return plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _finite(text: str) -> float | int:
    """Whole numbers are written without a point, as 1.0 and 1 are one number; what no double holds is no JSON number."""
    x = float(text)
    if x - x != 0:
        raise ValueError(text)
    return int(x) if x.is_integer() and abs(x) < 2**53 else x


def _refuse(name: str) -> None:
    raise ValueError(name)


def decoded(text: str) -> Any:
    """The value of a JSON text. Raises ValueError for anything else: NaN, numbers beyond doubles, nesting too deep to walk."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_refuse)
        json.dumps(value)
        return value
    except RecursionError:
        raise ValueError("nested too deeply") from None


def schema_error(value: Any, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a schema (type, enum, lengths, bounds, properties, required, items), or None."""
    kind = schema.get("type")
    if kind is not None:
        kinds = kind if isinstance(kind, list) else [kind]

        def fits(k: str) -> bool:
            if k == "integer":
                return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
            if k == "number":
                return isinstance(value, int | float) and not isinstance(value, bool)
            return k in TYPES and isinstance(value, TYPES[k])

        if not any(fits(k) for k in kinds):
            return f"{at}: not of type {'/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at}: too long"
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of bounds"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if error := schema_error(x, schema["items"], f"{at}[{i}]"):
                return error
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if error := schema_error(value[name], known[name], f"{at}.{name}"):
                    return error
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: not allowed"
    return None


PARSED = "kind string, conv_id long, turn long, pos int, role string, call_id string, name string, arguments string, after array<string>, content string"


def _object(text: str) -> dict | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        value = decoded(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _text(value: Any) -> str | None:
    return None if value is None else plain(value) if isinstance(value, str) else canonical(value)


def _needs(value: Any) -> list[str]:
    return [x for x in map(_text, value if isinstance(value, list) else [value]) if x is not None]


def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Calls, results and, of all other messages, context."""
    for pdf in batches:
        rows: list[tuple] = []
        for conv, turn, role, text in zip(pdf["conv_id"].astype("Int64"), pdf["turn"].astype("Int64"), pdf["role"], pdf["text"], strict=True):
            value = _object(text) if text else None
            if value and isinstance(value.get("tool_calls"), list):
                for i, call in enumerate(value["tool_calls"]):
                    call = call if isinstance(call, dict) else {}
                    arguments = call.get("arguments", {})
                    rows.append(("call", conv, turn, i, role, _text(call.get("id")), _text(call.get("name")), _text(arguments), _needs(call.get("after")), None))
            elif value and "tool_call_id" in value:
                rows.append(("result", conv, turn, 0, role, _text(value["tool_call_id"]), None, None, None, _text(value.get("content"))))
            elif role == "user" and turn is not pd.NA:
                rows.append(("call", conv, turn, 0, role, f"turn-{turn}", "reply", canonical({"text": text}), [f"turn-{turn - 2}"], None))
            elif role == "assistant" and turn is not pd.NA:
                rows.append(("result", conv, turn, 0, role, f"turn-{turn - 1}", None, None, None, text))
            else:
                rows.append(("context", conv, turn, 0, role, None, None, None, None, text))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")])
        yield out.astype({"conv_id": "Int64", "turn": "Int64"})


LINKED = "conv_id long, position long, depth long, turn long, call_id string, name string, status string, error string, n_results long, json string"
LINES_A_ROW = 256


def node_of(conv: str, call: str | Column) -> Column:
    """One identifier for a call of a conversation; null for a call without one."""
    return F.concat(F.coalesce(F.col(conv).cast("string"), F.lit("")), F.lit(":"), call)


def depths(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """node, depth: the longest way to a call over the calls that it needs; null for calls that need themselves, directly or through others.

    calls: node, needs (nodes; those that aren't calls don't count). A call that needs one other hangs on it: pointer doubling brings
    each such chain to its anchor, a call that needs none or several, in as many rounds as the logarithm of its length. Calls that need
    several are then resolved level by level, each as soon as all that it needs are; what never is needs itself.
    """
    known = calls.select(F.col("node").alias("up"))
    edges = scratch.save(calls.select("node", F.explode(F.array_distinct("needs")).alias("up")).join(known, "up").select("node", "up"))
    counts = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("up").alias("up"))
    single = F.col("n") == 1
    state = calls.select("node").join(counts, "node", "left")
    state = scratch.save(state.select("node", F.when(single, F.col("up")).alias("up"), F.when(single, 1).otherwise(0).cast("long").alias("far"), F.when(single, None).otherwise(F.col("node")).alias("anchor"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("several")))
    most, rounds = None, 0
    while True:
        left = state.where("up IS NOT NULL").count()
        most = left if most is None else most
        if not left or 2**rounds > most:  # chains are no longer than the calls that were open at first
            break
        above = state.select(F.col("node").alias("i"), F.col("up").alias("upper"), F.col("far").alias("more"), F.col("anchor").alias("found"))
        new = state.join(above, F.col("up") == F.col("i"), "left")
        new = scratch.save(new.select("node", F.col("upper").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.coalesce("anchor", "found").alias("anchor"), "several"))
        scratch.drop(state)
        state, rounds = new, rounds + 1
    state = state.withColumn("anchor", F.when(F.col("up").isNull(), F.col("anchor")))
    resolved = state.where("anchor = node AND NOT several").select(F.col("node").alias("at"), F.lit(0).cast("long").alias("depth"))
    joins = state.where("several").select("node")
    if not joins.isEmpty():
        way = state.select(F.col("node").alias("up"), "anchor", "far")
        asked = scratch.save(edges.join(joins, "node").join(way, "up").select("node", "anchor", (F.col("far") + 1).alias("far")))
        resolved = scratch.save(resolved)
        while True:
            reached = asked.join(resolved, F.col("anchor") == F.col("at"), "left")
            ready = reached.groupBy("node").agg(F.count("*").alias("n"), F.count("depth").alias("known"), F.max(F.col("depth") + F.col("far")).alias("depth"))
            ready = scratch.save(ready.where("n = known").select(F.col("node").alias("at"), "depth"))
            if ready.isEmpty():
                break
            resolved = scratch.save(resolved.union(ready))
            asked = scratch.save(asked.join(ready, F.col("node") == F.col("at"), "left_anti"))
    return state.join(resolved, F.col("anchor") == F.col("at"), "left").select("node", (F.col("depth") + F.col("far")).alias("depth"))


def link(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """A row per call, per result without a call, and per other message: conv_id, position, depth, turn, call_id, name, status, error, n_results, json.

    position numbers a conversation's rows from 1 in topological order: by depth, then turn; rows without a depth come last.
    status: ok; invalid (error says how the arguments break the schema, or that the function is unknown); unanswered; cyclic; duplicate
    (a later call with the same identifier, or one without any); orphan (a result without a call); context (any other message). Of
    several results of a call the earliest counts and n_results says how many there are. Repeated rows are one message. A null
    conversation is a conversation of its own; null roles, turns and texts make context or empty contents. Text that isn't JSON, or is
    nested too deeply, or holds NaN is text. Half surrogate pairs are written as escapes. Other columns are left out. An empty table
    gives no rows.
    """
    schemas = SCHEMAS if schemas is None else schemas
    scratch = Scratch(messages.sparkSession, "tool-chat")
    used = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    parsed = scratch.save(used.distinct().mapInPandas(parse, PARSED).withColumn("node", node_of("conv_id", F.col("call_id"))))
    # calls that are alike in everything are counted, so the first of a node is one row whatever repeats
    what = F.struct(F.col("turn").isNull().alias("late"), "turn", "pos", "name", "arguments", "role", "after")
    calls = scratch.save(parsed.where("kind = 'call'").groupBy("conv_id", "call_id", "node", what.alias("o")).agg(F.count("*").alias("copies")))
    first = scratch.save(calls.where("node IS NOT NULL").groupBy("node").agg(F.min("o").alias("o"), F.first("conv_id").alias("conv_id"), F.first("call_id").alias("call_id")))
    needs = F.transform("o.after", lambda x: node_of("conv_id", x))
    depth = depths(first.select("node", needs.alias("needs")), scratch).select(F.col("node").alias("dn"), "depth")
    results = (
        parsed.where("kind = 'result'")
        .groupBy(F.col("node").alias("rn"))
        .agg(F.first("conv_id").alias("rc"), F.first("call_id").alias("ri"), F.min(F.struct(F.col("turn").isNull().alias("late"), "turn", "content")).alias("r"), F.count("*").alias("n_results"))
        .select("rn", "rc", "ri", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"), "n_results")
    )
    columns = ["kind", "conv_id", "turn", "pos", "role", "call_id", "name", "arguments", "depth", "result", "result_turn", "n_results"]
    answered = first.select("node", "conv_id", "call_id", "o.*").join(results, F.col("node") == F.col("rn"), "full_outer").join(depth, F.col("node") == F.col("dn"), "left")
    rows = (
        answered.withColumn("kind", F.when(F.col("node").isNull(), "orphan").otherwise("call"))
        .withColumn("conv_id", F.coalesce("conv_id", "rc"))
        .withColumn("call_id", F.coalesce("call_id", "ri"))
        .select(columns)
    )
    others = parsed.where("kind = 'context'").select("kind", "conv_id", "turn", "pos", "role", "call_id", "name", "arguments", F.col("content").alias("result"))
    chosen = first.select(F.col("node").alias("fn"), F.col("o").alias("fo"))
    more = calls.join(chosen, F.col("node") == F.col("fn"), "left").withColumn("n", F.col("copies") - F.coalesce((F.col("o") == F.col("fo")).cast("int"), F.lit(0)))
    again = more.where("n > 0").withColumn("again", F.explode(F.expr("sequence(1, cast(n as int))"))).select(F.lit("duplicate").alias("kind"), "conv_id", "call_id", "o.*").drop("late", "after")
    rows = rows.unionByName(others, allowMissingColumns=True).unionByName(again, allowMissingColumns=True).select(columns)

    def serialise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, last = TaskContext.get().partitionId(), 0, ()
        for pdf in batches:
            out = []
            for r in pdf.astype({"conv_id": "Int64", "turn": "Int64", "depth": "Int64", "n_results": "Int64", "result_turn": "Int64"}).itertuples(index=False):
                error, turn = None, r.turn
                if r.kind == "context":
                    status, value = "context", {"role": r.role, "text": r.result}
                elif r.kind == "orphan":
                    status, turn, value = "orphan", r.result_turn, {"call_id": r.call_id, "result": r.result}
                else:
                    try:
                        arguments = decoded(r.arguments) if r.arguments is not None else None
                    except ValueError:
                        arguments, error = r.arguments, "$: not JSON"
                    if error is None:
                        error = "unknown function" if r.name not in schemas else schema_error(arguments, schemas[r.name])
                    value = {"call": {"id": r.call_id, "name": r.name, "arguments": arguments}, "result": r.result}
                    if r.kind == "duplicate":
                        status = "duplicate"
                    elif r.depth is pd.NA:
                        status = "cyclic"
                    else:
                        status = "invalid" if error else "unanswered" if r.n_results is pd.NA else "ok"
                n = 0 if r.n_results is pd.NA else int(r.n_results)
                conv = None if r.conv_id is pd.NA else r.conv_id
                seen = seen + 1 if last == (conv,) else 1
                last = (conv,)
                out.append((part, r.conv_id, seen, r.depth, turn, r.call_id, r.name, status, error, n, canonical(value)))
            frame = pd.DataFrame(out, columns=["part", *[x.split()[0] for x in LINKED.split(", ")]])
            yield frame.astype({"conv_id": "Int64", "depth": "Int64", "turn": "Int64"})

    # a long conversation lies in many partitions, in order; each counts its own rows, and the counts before it are added
    order = [F.col("conv_id").asc_nulls_first(), F.col("depth").asc_nulls_last(), F.coalesce("turn", "result_turn").asc_nulls_last(), "pos", "call_id", "kind", "name", "arguments", "role", "result"]
    written = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(serialise, f"part int, {LINKED}"))
    convs = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    counts = written.groupBy("part", convs.alias("conv")).agg(F.max("position").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only conversations that lie in several partitions have anything before a partition
    shifts = scratch.save(counts.select(F.col("part").alias("p"), "conv", before.alias("before")).where("before > 0"))
    placed = written.join(shifts, (F.col("part") == F.col("p")) & (convs == F.col("conv")), "left")
    return placed.withColumn("position", F.col("position") + F.coalesce("before", F.lit(0))).select([x.split()[0] for x in LINKED.split(", ")])


def transcripts(linked: DataFrame, lines: int = LINES_A_ROW) -> DataFrame:
    """conv_id, block, n_lines, lines: conversations as canonical JSON lines in topological order, ``lines`` to a block.

    Blocks are numbered from 0, so a conversation of any length is a sequence of rows of bounded size.
    """
    block = F.floor((F.col("position") - 1) / lines).alias("block")
    rows = linked.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("position", "json"))).alias("of"))
    return rows.select("conv_id", "block", F.size("of").cast("long").alias("n_lines"), F.array_join("of.json", "\n").alias("lines"))


def op3_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
