"""Tool calls linked to their results: hash join by identifier, topological order, schema checks, canonical JSON.

A call has an identifier, a name, arguments as JSON text and, in ``after``, the identifier of the call whose result it builds on (null
for none). Results meet their call in a hash join. The order is topological: a call's ``level`` is the number of calls before it on its
path, found by pointer doubling, so a chain of n calls takes log2(n) joins. Arguments are validated against the JSON schema of the name,
and the message is written as canonical JSON: no white space, keys by UTF-16 code units, numbers as RFC 8785 has them.
Arguments that cannot be written so are ``bad_json``: numbers beyond a double, half surrogate pairs, nesting beyond ``DEPTH``.

All joins are salted look-ups, so one call may be followed by, or one identifier repeated in, any share of the rows; no
conversation is ever collected. Sorting by (level, call_id) gives an order in which each call comes after the one it builds on.

``status`` is the first that holds: ``no_id`` (null identifier; never linked), ``orphan_result`` (a result without call), ``cycle`` (its path
does not end), ``unknown_tool``, ``bad_json``, ``bad_arguments``, ``dangling`` (builds on a call that is not there; level 0),
``no_result``, ``ok``. Rows that repeat an identifier are one call, the smallest of them by (after, name, arguments); ``n_calls`` and ``n_results``
count them; of several results the smallest (at, content) is taken. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import only, salted_lookup

# Fixed value: JSON names of Python's types.
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}

#: levels of nesting that arguments may have
DEPTH = 200


def number(x: float) -> str:
    """A finite double as RFC 8785 writes it: shortest digits, no exponent from 1e-6 up to 1e21."""
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" not in text:
        return text
    digits, power = text.split("e")
    if -7 < int(power) < 0:
        return format(Decimal(text), "f")
    return f"{digits}e{int(power):+d}"


def canonical(value) -> str:
    """Canonical JSON text."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return number(value)
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, KINDS[kind])


def _same(a, b) -> bool:
    """Equality of JSON values: true is not 1."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def fits(value, schema: dict) -> bool:
    """Whether a value satisfies a schema: type or types, enum, bounds, lengths, items, properties, required, additionalProperties."""
    kinds = schema.get("type") or []
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        return False
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf)
    if isinstance(value, list):
        return all(fits(v, schema.get("items", {})) for v in value)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if not all(k in value for k in schema.get("required", ())) or schema.get("additionalProperties") is False and set(value) - set(known):
            return False
        return all(fits(v, known[k]) for k, v in value.items() if k in known)
    return True


def _no_constant(name: str):
    raise ValueError(name)


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(text)
    return x


def _shallow(value) -> bool:
    """Whether a value has at most DEPTH levels, found without recursion."""
    level, depth = [value], 0
    while level:
        depth += 1
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
    return depth <= DEPTH


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str, object]:
    """(status, parsed arguments)."""
    if name not in schemas:
        return "unknown_tool", None
    try:
        value = json.loads(arguments or "", parse_constant=_no_constant, parse_float=_finite)
        if not _shallow(value):
            return "bad_json", None
        canonical(value).encode()  # half surrogate pairs have no UTF-8
    except (ValueError, RecursionError):
        return "bad_json", None
    return ("ok" if fits(value, schemas[name]) else "bad_arguments"), value


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level, cycle, dangling) of (call_id, after), one row per call_id, by pointer doubling."""
    ids = calls.select("call_id", F.lit(True).alias("there"))
    start = salted_lookup(calls.select("call_id", F.col("after").alias("up")), ids.withColumnRenamed("call_id", "up"), ["up"], F.xxhash64("call_id"))
    dangling = F.col("up").isNotNull() & F.col("there").isNull()
    state = start.select("call_id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("level"), dangling.alias("dangling"))
    state = cut_lineage(state)
    n = state.count()
    for _ in range(n.bit_length() + 1):  # after r rounds a path of 2 ** r calls has ended, or never will
        open_ = state.where("up IS NOT NULL")
        if not open_.head(1):
            break
        known = state.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("level2"))
        moved = salted_lookup(open_, known, ["up"], F.xxhash64("call_id"))
        moved = moved.select("call_id", F.col("up2").alias("up"), (F.col("level") + F.col("level2")).alias("level"), "dangling")
        state = cut_lineage(state.where("up IS NULL").unionByName(moved))
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"), F.col("up").isNotNull().alias("cycle"), "dangling")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per orphan result: call_id, level, status, n_calls, n_results, message.

    ``calls`` has call_id, after, name, arguments; ``results`` has call_id, at, content.
    """
    calls = cut_lineage(only(calls, call_id="call_id", after="after", name="name", arguments="arguments"))
    results = only(results, call_id="call_id", at="at", content="content")
    one = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in ("after", "name", "arguments")])  # nulls last
    once = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(one).alias("c"), F.count("*").alias("n_calls"))
    once = cut_lineage(once.select("call_id", *[F.col(f"c.{c}.{c}").alias(c) for c in ("after", "name", "arguments")], "n_calls"))
    got = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("at", "content")).alias("r"), F.count("*").alias("n_results"))
    linked = once.join(levels(once), "call_id").join(got, "call_id", "full")
    nameless = calls.where("call_id IS NULL").select("call_id", "after", "name", "arguments", F.lit(1).cast("long").alias("n_calls"))
    lost = results.where("call_id IS NULL").select("call_id", F.struct("at", "content").alias("r"), F.lit(1).cast("long").alias("n_results"))
    rows = linked.unionByName(nameless, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
    rows = rows.select("call_id", "level", "cycle", "dangling", "name", "arguments", "after", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("r.content").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.astype(object).where(b.notna(), None).itertuples():
                status, value = checked(r.name, r.arguments, schemas)
                if r.call_id is None:
                    status = "no_id"
                elif not r.n_calls:
                    status = "orphan_result"
                elif r.cycle:
                    status = "cycle"
                elif status == "ok":
                    status = "dangling" if r.dangling else "no_result" if not r.n_results else "ok"
                message = {"id": r.call_id, "name": r.name, "arguments": r.arguments if value is None else value, "after": r.after, "result": r.content}
                out.append((r.call_id, r.level, status, r.n_calls, r.n_results, canonical(message)))
            yield pd.DataFrame(out, columns=["call_id", "level", "status", "n_calls", "n_results", "message"]).astype({"level": "Int64"})

    return rows.mapInPandas(run, "call_id string, level long, status string, n_calls long, n_results long, message string")


# The tools of the registered query.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 400}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query", "limit"], "additionalProperties": False},
    "translate": {"type": "object", "properties": {"text": {"type": "string", "maxLength": 4000}, "to": {"enum": ["de", "en", "es", "fr"]}}, "required": ["text", "to"]},
    "summarise": {"type": "object", "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 5}}, "required": ["text", "words"]},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat turns: a user's turn asks a tool (chosen by hash), an assistant's turn answers the turn before it.

    A call builds on the user's turn two before. Null texts become empty ones; rows without conversation or turn have no identifier.
    """
    rows = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    pick = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(3))
    arguments = (
        F.when(pick == 0, F.to_json(F.struct(F.col("text").alias("query"), (F.col("turn") + 1).alias("limit"))))
        .when(pick == 1, F.to_json(F.struct(F.lit("en").alias("to"), F.col("text").alias("text"))))
        .otherwise(F.to_json(F.struct(F.expr("length(text) div 20").alias("words"), F.col("text").alias("text"))))
    )
    tool = F.element_at(F.array(*[F.lit(t) for t in ("search", "translate", "summarise")]), (pick + 1).cast("int"))
    calls = rows.where("role = 'user'").select(F.when(known, name(F.col("turn"))).alias("call_id"), F.when(known & (F.col("turn") >= 2), name(F.col("turn") - 2)).alias("after"), tool.alias("name"), arguments.alias("arguments"))
    results = rows.where("role = 'assistant'").select(F.when(known, name(F.col("turn") - 1)).alias("call_id"), F.col("turn").alias("at"), F.col("text").alias("content"))
    return calls, results
