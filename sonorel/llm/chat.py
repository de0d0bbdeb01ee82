"""Chat formatting with linked tool calls.

A message's text may be a JSON object: ``{"content", "tool_calls": [{"id", "name", "arguments"}]}`` of an
assistant, or ``{"tool_call_id", "content"}`` of a tool. Everything else is plain content.

* Calls and results are joined by (conversation, call id); the first call of an id wins.
* A result follows its call, and a message whose arguments hold ``{"$result": id}`` follows that result. The
  order is topological: messages without open predecessors are placed, round by round, chains as a whole, and a message's
  key is (largest turn on its way, steps on its way, turn), which sorts every message behind its predecessors.
  Messages on a cycle keep their turn and are marked.
* Arguments are validated against the tools' JSON schemas.
* A message is written as canonical JSON: keys sorted, no blanks, UTF-8 as it is.

Results have one row per message, so a conversation of any length is spread over tasks; sorting by (conv_id,
order_turn, order_step, turn) gives the conversation.

Defined results: null text is empty content; a null role is the empty role; rows that repeat a message are
written each; texts that aren't valid JSON objects of the forms above are content as they are; an empty table
gives no rows; extra columns are ignored; messages without conversation or turn are formatted, but link with nothing;
JSON deeper than ``DEEPEST`` levels, with NaN or infinite numbers, with integers of more than 4 300 digits or half a surrogate
pair is no JSON; of an object's repeated keys the last counts. Texts are taken whole, however long.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel.llm import common

#: Schemas of the tools that a call may name, by name; a caller gives its own.
TOOLS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}

#: Levels of nesting that JSON may have.
DEEPEST = 200

_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def is_type(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, ()))


def faults(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What is wrong with ``value`` under a JSON schema (type, enum, const, properties, required,
    additionalProperties, items, bounds of numbers, strings and arrays; true allows everything, false nothing)."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(is_type(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += faults(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += faults(v, schema["additionalProperties"], f"{at}.{k}")
    elif isinstance(value, list):
        size = len(value)
        if "items" in schema:
            out += [f for i, v in enumerate(value) for f in faults(v, schema["items"], f"{at}[{i}]")]
        if size < schema.get("minItems", 0) or size > schema.get("maxItems", size):
            out.append(f"{at}: {size} items")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: {len(value)} characters")
    elif is_type(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of bounds")
    return out


def no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def finite(digits: str) -> float:
    if not math.isfinite(x := float(digits)):
        raise ValueError(f"{digits} is no finite number")
    return x


def loads(text: str):
    """The value of a JSON text; ValueError for one that is no JSON, or too deep."""
    try:
        value = json.loads(text, parse_constant=no_constant, parse_float=finite)
    except RecursionError:
        raise ValueError("too deep") from None
    level, depth = [value], 0
    while level:  # level by level: a value of any depth is measured
        depth += 1
        if depth > DEEPEST:
            raise ValueError("too deep")
        level = [v for x in level if isinstance(x, dict | list) for v in (x.values() if isinstance(x, dict) else x)]
    if "\\u" in text:
        canonical(value).encode()  # half a surrogate pair is no text
    return value


def references(value) -> list[str]:
    """Ids of the results that arguments refer to."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def parse(role: str | None, text: str | None, tools: dict[str, dict]) -> dict:
    """line, calls (ids), answers (id or None), needs (ids of results), problems of one message."""
    message = {"role": role or "", "content": text or ""}
    calls, needs, problems, answers = [], [], [], None
    body = None
    if text and text.lstrip()[:1] == "{":
        try:
            body = loads(text)
        except ValueError:
            body = None
    if isinstance(body, dict) and role == "assistant" and isinstance(body.get("tool_calls"), list):
        message["content"] = body.get("content") if isinstance(body.get("content"), str) else ""
        message["tool_calls"] = []
        for k, c in enumerate(body["tool_calls"]):
            c = c if isinstance(c, dict) else {}
            c = c | (c["function"] if isinstance(c.get("function"), dict) else {})
            args = c.get("arguments", {})
            if isinstance(args, str):
                try:
                    args = loads(args)
                except ValueError:
                    problems.append(f"call {k}: arguments are no JSON")
            name = c.get("name")
            if not isinstance(c.get("id"), str):
                problems.append(f"call {k}: no id")
            else:
                calls.append(c["id"])
            if not isinstance(name, str) or name not in tools:
                problems.append(f"call {k}: unknown tool")
            else:
                problems += [f"call {k}: {f}" for f in faults(args, tools[name])]
            needs += references(args)
            message["tool_calls"].append({"id": c.get("id"), "name": name, "arguments": args})
    elif isinstance(body, dict) and role == "tool" and isinstance(body.get("tool_call_id"), str):
        answers = message["tool_call_id"] = body["tool_call_id"]
        content = body.get("content", "")
        message["content"] = content if isinstance(content, str) else canonical(content)
    return {"line": canonical(message), "calls": calls, "answers": answers, "needs": needs, "problems": problems}


PARSED = "conv_id long, turn long, role string, line string, calls array<string>, answers string, needs array<string>, problems array<string>"


def _parsed(rows: DataFrame, tools: dict[str, dict]) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [parse(r.as_py(), t.as_py(), tools) for r, t in zip(b.column(2), b.column(3), strict=True)]
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([g["line"] for g in got], pa.string()), pa.array([g["calls"] for g in got], texts), pa.array([g["answers"] for g in got], pa.string()), pa.array([g["needs"] for g in got], texts), pa.array([g["problems"] for g in got], texts)],
                names=["conv_id", "turn", "role", "line", "calls", "answers", "needs", "problems"],
            )

    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(run, PARSED)


def _edges(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, before, after) between turns, and (conv_id, turn) of results without a call."""
    calls = parsed.select("conv_id", "turn", F.explode("calls").alias("id")).groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"))
    results = parsed.filter("answers is not null").select("conv_id", F.col("answers").alias("id"), "turn")
    linked = results.join(calls, ["conv_id", "id"], "left")
    needs = parsed.select("conv_id", "turn", F.explode("needs").alias("id")).distinct()
    first = results.groupBy("conv_id", "id").agg(F.min("turn").alias("result_turn"))
    edges = (
        linked.filter("call_turn is not null")
        .select("conv_id", F.col("call_turn").alias("before"), F.col("turn").alias("after"))
        .union(needs.join(first, ["conv_id", "id"]).select("conv_id", F.col("result_turn").alias("before"), F.col("turn").alias("after")))
        .filter("before <> after")
        .distinct()
    )
    return edges, linked.filter("call_turn is null").select("conv_id", "turn").distinct()


def _after(turn, step):
    """Place of a turn at the end of a jump (top, since, length) that starts at a turn placed at (turn, step)."""
    top, since, length = map(F.col, ("top", "since", "length"))
    return F.when(turn.isNotNull(), F.when(F.coalesce(top > turn, F.lit(False)), F.struct(top.alias("order_turn"), since.alias("order_step"))).otherwise(F.struct(turn.alias("order_turn"), (step + length).alias("order_step"))))


def _jumps(nodes: DataFrame) -> DataFrame:
    """conv_id, turn, to, top, since, length of every turn with one predecessor: the last turn before it that has none or several,
    and on the way from there the largest turn, the steps since that, and all steps. Jumps double in every round, so a chain takes as
    many rounds as its length has binary digits. ``to`` is null on and behind a cycle of such turns: a jump is longer than all of them."""
    one = nodes.filter("n_into = 1").select("conv_id", "turn", F.col("before").alias("to"), F.col("turn").alias("top"), F.lit(0).alias("since"), F.lit(1).alias("length"))
    jumps = common.materialize(one, "jumps")
    most = jumps.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= most:
        reach *= 2
        u = jumps.select("conv_id", F.col("turn").alias("to"), F.lit(True).alias("hit"), F.col("to").alias("u_to"), F.col("top").alias("u_top"), F.col("since").alias("u_since"), F.col("length").alias("u_length"))
        higher = F.col("top") > F.col("u_top")
        further = F.when(F.col("hit"), F.struct(F.col("u_to").alias("to"), F.greatest("top", "u_top").alias("top"), F.when(higher, F.col("since")).otherwise(F.col("u_since") + F.col("length")).alias("since"), (F.col("u_length") + F.col("length")).alias("length")))
        further = F.coalesce(further, F.struct("to", "top", "since", "length"))
        moved = jumps.join(u, ["conv_id", "to"], "left").select("conv_id", "turn", further.alias("j"), F.col("hit").alias("moved")).select("conv_id", "turn", "j.*", "moved")
        jumps = common.materialize(moved, "jumps")
        if jumps.filter("moved").isEmpty():
            return jumps.drop("moved")
        jumps = jumps.drop("moved")
    ends = nodes.filter("n_into <> 1").select("conv_id", F.col("turn").alias("to"), F.lit(True).alias("end"))
    return jumps.join(ends, ["conv_id", "to"], "left").withColumn("to", F.when(F.col("end"), F.col("to"))).drop("end")


def _placed(edges: DataFrame) -> DataFrame:
    """conv_id, turn, order_turn, order_step, cycle of every turn on an edge. Turns with one predecessor are reached by jumps over
    whole chains; Kahn's rounds place those with several, each round by one write, as many as lie behind one another."""
    key, place = ["conv_id", "turn"], ["order_turn", "order_step"]
    ends = edges.select("conv_id", F.col("before").alias("turn"), F.lit(None).cast("long").alias("before"), F.lit(0).alias("into")).union(edges.select("conv_id", F.col("after").alias("turn"), "before", F.lit(1)))
    nodes = common.materialize(ends.groupBy(*key).agg(F.sum("into").alias("n_into"), F.max("before").alias("before")), "nodes")
    jumps = common.materialize(_jumps(nodes), "jumps")
    done = nodes.filter("n_into <> 1").select(*key, F.when(F.col("n_into") == 0, F.col("turn")).alias("order_turn"), F.lit(0).alias("order_step"))
    many = nodes.filter("n_into > 1").select("conv_id", F.col("turn").alias("after"))
    if not many.isEmpty():
        # edges into a turn of several, each from the start of the chain that its predecessor ends
        starts = edges.join(many, ["conv_id", "after"]).join(jumps.withColumnRenamed("turn", "before").withColumn("chain", F.lit(True)), ["conv_id", "before"], "left")
        starts = starts.select("conv_id", "after", F.when(F.col("chain"), F.col("to")).otherwise(F.col("before")).alias("turn"), "top", F.coalesce("since", F.lit(0)).alias("since"), F.coalesce("length", F.lit(0)).alias("length"))
        starts, done = common.materialize(starts, "starts"), common.materialize(done, "placed")
        seen = 0
        while (now := done.filter("order_turn is not null").count()) > seen:
            seen = now
            # an open turn is placed when every edge into it starts at a placed one
            into = starts.join(done, key, "left").select("conv_id", F.col("after").alias("turn"), _after(F.col("order_turn"), F.col("order_step")).alias("m"))
            ready = into.groupBy(*key).agg(F.count("*").alias("n"), F.count("m").alias("k"), F.max("m").alias("m")).filter("n = k")
            both = done.join(ready.select(*key, "m"), key, "left")
            open_ = F.col("order_turn").isNull() & F.col("m").isNotNull()
            step = F.when(F.col("turn") > F.col("m.order_turn"), 0).otherwise(F.col("m.order_step") + 1)
            done = common.materialize(both.select(*key, F.when(open_, F.greatest("turn", "m.order_turn")).otherwise(F.col("order_turn")).alias("order_turn"), F.when(open_, step).otherwise(F.col("order_step")).alias("order_step")), "placed")
    chained = jumps.join(done.withColumnRenamed("turn", "to"), ["conv_id", "to"], "left").select(*key, _after(F.col("order_turn"), F.col("order_step")).alias("m")).select(*key, *(F.col(f"m.{c}").alias(c) for c in place))
    placed = done.unionByName(chained)
    return placed.select(*key, F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_step", F.lit(0)).alias("order_step"), F.col("order_turn").isNull().alias("cycle"))


def format_messages(rows: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, order_turn, order_step, n_calls, valid, problems, line."""
    parsed = _parsed(rows, TOOLS if tools is None else tools)
    # links between messages are few beside the messages: written once, joined back by size
    tied = common.materialize(parsed.filter("(size(calls) > 0 or answers is not null) and conv_id is not null and turn is not null").drop("line"), "tied")
    edges, orphans = _edges(tied)
    edges = common.materialize(edges, "edges")
    placed = _placed(edges).join(orphans.withColumn("orphan", F.lit(True)), ["conv_id", "turn"], "full")
    placed = common.small_side(common.materialize(placed, "order"), 48)
    joined = parsed.join(placed, ["conv_id", "turn"], "left")
    more = F.concat(
        F.col("problems"),
        F.when(F.col("orphan"), F.array(F.lit("result of no call"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("cycle"), F.array(F.lit("calls and results form a cycle"))).otherwise(F.array().cast("array<string>")),
    )
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("order_turn", "turn").alias("order_turn"),
        F.coalesce("order_step", F.lit(0)).alias("order_step"),
        F.size("calls").alias("n_calls"),
        (F.size(more) == 0).alias("valid"),
        F.array_join(more, "; ").alias("problems"),
        "line",
    )
