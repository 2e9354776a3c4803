"""Chat formatting with tool-call linking.

Messages whose text is a JSON object may call tools ({"tool_calls": [{"id", "name", "arguments"}]}), answer a call
({"tool_call_id", "content"}), or both. Calls and results are hash-joined by conversation and identifier; messages are
ordered topologically, also along chains of calls, by pointer jumping; arguments are checked against the tools' schemas,
and each message is written as canonical JSON. No conversation is gathered: places come from ranges of all messages.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, scratch, texts_in_batches, written

#: JSON types by name, as a schema's "type" states them.
TYPES: dict[str, type | tuple[type, ...]] = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


#: Turns that are null stand first.
FIRST = -(2**63)


def _refused(constant: str) -> Any:
    raise ValueError(f"{constant} is no JSON")


def _number(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _refused(digits)


def parsed(text: str) -> Any:
    """Strict JSON: ValueError for NaN, infinities, numbers beyond a double, and nesting beyond the parser's depth."""
    try:
        return json.loads(text, parse_constant=_refused, parse_float=_number)
    except RecursionError:
        return _refused("so deep a value")


def escaped(text: str) -> str:
    """Lone surrogates, which no encoding has, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value: Any) -> str:
    """Keys sorted, no spaces, no escapes beyond JSON's own."""
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def same(a: Any, b: Any) -> bool:
    """Equal as JSON: true is not 1, 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def _is(value: Any, kind: Any) -> bool:
    if kind == "null":
        return value is None
    return isinstance(kind, str) and kind in TYPES and isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def satisfies(value: Any, schema: Any) -> bool:
    """fits(), and False for a schema that is none, such as one with a bound that is no number or a pattern that is none."""
    try:
        return fits(value, schema)
    except (TypeError, AttributeError, re.error):
        return False


def _named(root: Any, ref: Any) -> Any:
    """What a reference within the schema names; None if nothing."""
    if not isinstance(ref, str) or not ref.startswith("#"):
        return None
    for part in filter(None, ref[1:].split("/")):
        part = part.replace("~1", "/").replace("~0", "~")
        root = root.get(part) if isinstance(root, dict) else None
    return root


def fits(value: Any, schema: Any, root: Any = None, depth: int = 0) -> bool:
    """Whether a value satisfies a JSON schema; keywords beyond these say nothing.

    type (one or several), enum, const, required, properties, additionalProperties, items, the bounds of numbers, lengths and
    counts, pattern, uniqueItems, allOf, anyOf, oneOf, not, and references within the schema. A reference that leads nowhere,
    or round in a circle, is satisfied by nothing.
    """
    if isinstance(schema, bool) or not isinstance(schema, Mapping):
        return schema is not False
    root = schema if root is None else root
    if depth > 64:
        return False
    inner = lambda v, s: fits(v, s, root, depth + 1)
    if "$ref" in schema and ((target := _named(root, schema["$ref"])) is None or not inner(value, target)):
        return False
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return False
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]) or "const" in schema and not same(value, schema["const"]):
        return False
    if not all(inner(value, s) for s in schema.get("allOf", ())) or "anyOf" in schema and not any(inner(value, s) for s in schema["anyOf"]):
        return False
    if "oneOf" in schema and sum(inner(value, s) for s in schema["oneOf"]) != 1 or "not" in schema and inner(value, schema["not"]):
        return False
    within = lambda n, least, most: schema.get(least, n) <= n <= schema.get(most, n)
    if _is(value, "number"):
        return within(value, "minimum", "maximum") and schema.get("exclusiveMinimum", -math.inf) < value < schema.get("exclusiveMaximum", math.inf)
    if isinstance(value, str):
        return within(len(value), "minLength", "maxLength") and ("pattern" not in schema or re.search(schema["pattern"], value) is not None)
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", ())):
            return False
        return all(inner(v, known.get(k, more)) for k, v in value.items())
    if isinstance(value, list):
        unique = not schema.get("uniqueItems") or not any(same(a, b) for i, a in enumerate(value) for b in value[:i])
        return within(len(value), "minItems", "maxItems") and unique and all(inner(v, schema.get("items", True)) for v in value)
    return True


def read(role: str | None, text: str | None, schemas: Mapping[str, Mapping[str, Any]]) -> tuple[str, list[str], int, str | None]:
    """Canonical message, ids of its calls, how many of them have arguments that fit, and the id it answers."""
    try:
        value = parsed(text) if text and text.lstrip()[:1] == "{" else None
        if isinstance(value, dict):
            calls = [c for c in value["tool_calls"] if isinstance(c, dict) and isinstance(c.get("id"), str)] if isinstance(value.get("tool_calls"), list) else None
            answers = value["tool_call_id"] if isinstance(value.get("tool_call_id"), str) else None
            if calls is not None or answers is not None:
                good = 0
                for c in calls or ():
                    if isinstance(c.get("arguments"), str):
                        try:
                            c["arguments"] = parsed(c["arguments"])
                        except ValueError:
                            pass
                    schema = schemas.get(c["name"]) if isinstance(c.get("name"), str) else None
                    good += schema is not None and isinstance(c.get("arguments"), dict) and satisfies(c["arguments"], schema)
                return canonical({**value, "role": role}), [escaped(c["id"]) for c in calls or ()], good, None if answers is None else escaped(answers)
    except (ValueError, RecursionError):
        pass
    return canonical({"role": role, "content": text or ""}), [], 0, None


def _read(schemas: Mapping[str, Mapping[str, Any]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = [read(r, t, schemas) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(row, row + len(rows)), pa.int64()), batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string()),
            ], names=["row_", "conv_id", "turn", "message", "calls", "n_valid", "answers"])
            row += len(rows)

    return run


def placed(links: DataFrame) -> DataFrame:
    """(row_, after, steps): where messages that answer stand, the turn after which and how many steps behind it.

    links: row_, turn, up (the message that calls) and up_turn. Along a chain of calls a message follows the last of the
    highest turn so far. Each round joins every chain's segments in pairs. Messages in or below a circle of calls are left out.
    """
    inner = links.select("row_", F.col("turn").alias("after"), F.lit(0).alias("steps"), F.lit(1).alias("length"), "up")
    tops = links.select(F.col("up").alias("row_"), F.col("up_turn").alias("after")).distinct().join(links.select("row_"), "row_", "left_anti")
    now = written(inner.unionByName(tops.withColumns({"steps": F.lit(0), "length": F.lit(1), "up": F.lit(None).cast("long")})))
    for _ in range(now.count().bit_length() + 1):
        if now.where("up is not null").isEmpty():
            break
        over = now.select(F.col("row_").alias("up"), F.col("after").alias("a"), F.col("steps").alias("s"), F.col("length").alias("l"), F.col("up").alias("next"))
        now = now.join(over, "up", "left")
        own = F.col("a").isNull() | (F.col("after") > F.col("a"))  # the lower segment reaches a turn of its own
        now = written(now.select("row_", F.when(own, F.col("after")).otherwise(F.col("a")).alias("after"), F.when(own, F.col("steps")).otherwise(F.col("s") + F.col("length")).alias("steps"), (F.col("length") + F.coalesce("l", F.lit(0))).alias("length"), F.col("next").alias("up")))
    return now.where("up is null").select("row_", "after", "steps")


def chat_format(conversations: DataFrame, schemas: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """(conv_id, turn, position, n_calls, n_valid, n_answered, linked, message), one row per message.

    position counts from 0 within the conversation: by turn (null first), but a result stands after the message that calls
    it, directly behind the latest turn along its chain of calls; ties go by a digest of the message. Messages in or below a
    circle of calls keep to their turns. linked is null for messages that answer no call, else whether the call exists;
    n_answered counts a message's calls with a result. A call whose tool has no schema isn't valid. An identifier that
    calls share belongs to the earliest of them. Null roles and texts are written as null and empty; text that is no strict
    JSON object (NaN, numbers beyond a double) is plain content; lone surrogates stay escaped. Null conv_ids form one
    conversation. Repeated rows each have a place. An empty table gives an empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    with scratch(conversations.sparkSession) as keep:
        messages = keep(written(texts_in_batches(rows).mapInArrow(_read(schemas or {}), "row_ long, conv_id long, turn long, message string, calls array<string>, n_valid long, answers string")))
        keyed = messages.select("row_", "conv_id", F.coalesce("turn", F.lit(FIRST)).alias("at"), F.md5("message").alias("digest"), "calls", "answers")
        calls = keyed.select(F.col("conv_id").alias("c"), F.explode(F.array_distinct("calls")).alias("id"), F.struct("at", "digest", "row_").alias("caller")).groupBy("c", "id").agg(F.min("caller").alias("caller"))
        asked = keyed.where("answers is not null").select("row_", "conv_id", F.col("at").alias("turn"), "answers")
        links = asked.join(calls, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("answers") == F.col("id")))
        links = keep(written(links.select("row_", "turn", "id", F.col("caller.row_").alias("up"), F.col("caller.at").alias("up_turn"))))
        if links.isEmpty():
            keyed = keyed.select("row_", "conv_id", F.col("at").alias("after"), F.lit(0).alias("steps"), "at", "digest")
        else:
            keyed = keyed.join(placed(links.where("row_ <> up")), "row_", "left").select("row_", "conv_id", F.coalesce("after", "at").alias("after"), F.coalesce("steps", F.lit(0)).alias("steps"), "at", "digest")
        place = keep(written(positions(keyed, ["conv_id"], ["after", "steps", "at", "digest", "row_"]).select("row_", "position")))
    answered = links.groupBy(F.col("up").alias("row_")).agg(F.count_distinct("id").alias("n_answered"))
    out = messages.join(place, "row_").join(answered, "row_", "left").join(links.select("row_", F.lit(True).alias("met")), "row_", "left")
    return out.select(
        "conv_id", "turn", "position", F.size("calls").cast("long").alias("n_calls"), "n_valid",
        F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"), F.when(F.col("answers").isNotNull(), F.col("met").isNotNull()).alias("linked"), "message",
    )
