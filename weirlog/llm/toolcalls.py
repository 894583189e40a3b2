"""Linking tool calls to their results and putting them in an order they can run in.

Calls and results are joined by conversation and identifier; where an identifier
occurs more than once its first call meets its first result, found by an
aggregate that is combined before its shuffle, so the join is one to one. A call's
arguments may name earlier calls as ``{"$ref": id}``. In most conversations
the order of the turns already puts each call behind the ones it names; a join
finds those where it does not, and only there the depth of each call is found: a
conversation with few references is ordered by one task, of one with many all
tasks take away the calls that wait for nothing, in rounds. Positions come from a
parallel numbering, so a conversation that holds a third of all rows is not
brought into one task.

Arguments are parsed, held against the tool's JSON schema and written in
canonical form: members sorted, no blanks, text not escaped but for what UTF-8
cannot hold. No number is too large: those beyond a double or some thousand digits
are kept as decimals.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog.operators.numbering import with_sequence
from weirlog.session import Scratch

_TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
}
CYCLE_LEVEL = 2**31 - 1
MAX_WAITS = 200_000  # references of a conversation that one task puts in order


_LONG = 4000  # digits of whole numbers that Python reads and writes without a limit
_ALONE = re.compile("[\ud800-\udfff]")


def _whole(text: str) -> int | Decimal:
    return int(text) if len(text) <= _LONG else Decimal(text)


def _fraction(text: str) -> float | Decimal:
    """A double, or a decimal where it would be infinite, or zero without being zero."""
    value = float(text)
    if math.isinf(value) or (value == 0 and re.search("[1-9]", re.split("[eE]", text)[0])):
        return Decimal(text)
    return value


def parse(text: str):
    """A JSON text of any numbers; of members that repeat the last counts. ValueError where it is none."""
    return json.loads(text, parse_constant=_refuse, parse_int=_whole, parse_float=_fraction)


def escaped(text: str) -> str:
    """Surrogates that stand alone as JSON escapes, since UTF-8 has no place for them."""
    return _ALONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _written(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_written(k)}:{_written(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, Decimal):
        return str(value)
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def canonical(value) -> str:
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except TypeError:  # it holds decimals
        text = _written(value)
    return escaped(text)


def _refuse(text: str):
    raise ValueError(f"{text} is not JSON")


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
            return False
        # A number without a fraction is whole however it is written.
        return kind == "number" or isinstance(value, int) or _without_fraction(value)
    return isinstance(value, _TYPES[kind])


def _without_fraction(value: float | Decimal) -> bool:
    if isinstance(value, float):
        return value.is_integer()
    _, digits, exponent = value.as_tuple()
    return exponent >= 0 or not any(digits[exponent:])


def _same(a, b) -> bool:
    """Equality of JSON values: a truth value is no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def violations(value, schema: dict, at: str = "") -> list[str]:
    """Where a value breaks a schema of types, members, items, choices and bounds.

    A reference to another call's result fits any schema.
    """
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at or '/'}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(_same(value, choice) for choice in schema["enum"]):
        out.append(f"{at or '/'}: not one of the choices")
    if _is(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at or '/'}: out of range")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at or '/'}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at or '/'}: wrong pattern")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += violations(item, schema["items"], f"{at}/{i}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}/{name}: missing" for name in schema.get("required", []) if name not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}/{name}: unknown" for name in sorted(value) if name not in known]
        for name in sorted(value):
            if name in known:
                out += violations(value[name], known[name], f"{at}/{name}")
    return out


def references(value) -> set[str]:
    """Identifiers named by ``$ref`` anywhere in a value."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return {value["$ref"]}
        return set().union(*map(references, value.values()))
    if isinstance(value, list):
        return set().union(*map(references, value))
    return set()


def examine(name: str | None, text: str | None, schemas: dict[str, dict]) -> dict:
    """The canonical arguments of a call, what is wrong with them, and the calls they name."""
    try:
        value = parse(text if text else "{}")
        out = {"arguments": canonical(value), "errors": [], "refs": sorted(map(escaped, references(value)))}
        if name not in schemas:
            out["errors"] = ["unknown tool"]
        else:
            out["errors"] = list(map(escaped, violations(value, schemas[name])))
    except (ValueError, RecursionError) as e:
        why = "nested too deeply" if isinstance(e, RecursionError) else "not JSON"
        out = {"arguments": None, "errors": [why], "refs": []}
    return out


def examined(name: Column, text: Column, schemas: dict[str, dict]) -> Column:
    @F.arrow_udf("struct<arguments: string, errors: array<string>, refs: array<string>>")
    def run(names: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [examine(n, t, schemas) for n, t in zip(names.to_pylist(), texts.to_pylist())]
        kinds = [("arguments", pa.string()), ("errors", pa.list_(pa.string())), ("refs", pa.list_(pa.string()))]
        return pa.array(rows, pa.struct(kinds))

    return run(name, text)


def record(*columns: Column) -> Column:
    """The canonical JSON of a linked call; arguments are embedded as the JSON they are."""

    @F.arrow_udf("string")
    def run(ids: pa.Array, names: pa.Array, arguments: pa.Array, errors: pa.Array, status: pa.Array, results: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in (ids, names, arguments, errors, status, results)))
        keys = ("id", "name", "arguments", "errors", "status", "result")
        out = []
        for row in rows:
            value = dict(zip(keys, row))
            value["arguments"] = None if value["arguments"] is None else parse(value["arguments"])
            out.append(canonical(value))
        return pa.array(out, pa.string())

    return run(*columns)


def _ordered(table: pa.Table) -> pa.Table:
    """The levels of one conversation's calls: one more than the deepest call that each waits for."""
    conv, call, needs = (table.column(c).to_pylist() for c in ("conv_id", "call_id", "needs"))
    level = dict.fromkeys(call, CYCLE_LEVEL)
    missing, waiting = dict.fromkeys(call, 0), defaultdict(list)
    for c, n in zip(call, needs):
        if n is not None:
            missing[c] += 1
            waiting[n].append(c)
    ready, depth = [c for c, n in missing.items() if n == 0], 0
    while ready:
        later = []
        for done in ready:
            level[done] = depth
            for c in waiting[done]:
                missing[c] -= 1
                if not missing[c]:
                    later.append(c)
        ready, depth = later, depth + 1
    columns = [pa.array([conv[0]] * len(level), pa.int64()), pa.array(list(level), pa.string()), pa.array(list(level.values()), pa.int32())]
    return pa.table(columns, names=["conv_id", "call_id", "level"])


def _depths(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """``level`` of each of the calls (``conv_id``, ``call_id``), given what they wait for (``needs``)."""
    spark = calls.sparkSession
    waits = Scratch(spark).table(waits, "waits")
    long = waits.groupBy("conv_id").count().where(F.col("count") > MAX_WAITS).select("conv_id")
    long = Scratch(spark).table(long, "long-conversations")
    nodes = calls.withColumn("needs", F.lit(None).cast("string"))
    both = nodes.unionByName(waits).join(long, "conv_id", "left_anti").select("conv_id", "call_id", "needs")
    short = both.groupBy("conv_id").applyInArrow(_ordered, "conv_id bigint, call_id string, level int")
    if long.isEmpty():
        return short
    return short.unionByName(_depths_by_rounds(calls.join(long, "conv_id"), waits.join(long, "conv_id")))


def _depths_by_rounds(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """Rounds over calls (``conv_id``, ``call_id``) and what they wait for (``needs``): ``level`` of each."""
    spark = calls.sparkSession
    kept, scratch = Scratch(spark), Scratch(spark)
    left = scratch.table(waits, "waits")
    nodes = scratch.table(calls, "calls")
    levels = []
    depth = 0
    while True:
        blocked = left.select("conv_id", "call_id").distinct()
        ready = kept.table(
            nodes.join(blocked, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(depth)), "ready"
        )
        levels.append(ready)
        later = Scratch(spark)
        done = ready.select("conv_id", F.col("call_id").alias("needs"))
        nodes = later.table(nodes.join(blocked, ["conv_id", "call_id"], "left_semi"), "calls")
        left = later.table(left.join(done, ["conv_id", "needs"], "left_anti"), "waits")
        scratch.__exit__()
        scratch = later
        depth += 1
        if ready.isEmpty() or nodes.isEmpty():
            break
    # What is left waits for itself.
    levels.append(kept.table(nodes.withColumn("level", F.lit(CYCLE_LEVEL)), "cycles"))
    scratch.__exit__()
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per result that no call takes, in an order they can run in.

    ``calls`` has ``conv_id``, ``call_id``, ``turn``, ``name`` and ``arguments`` (JSON text),
    ``results`` ``conv_id``, ``call_id``, ``turn`` and ``content``; ids are whole numbers
    and texts. Result: ``conv_id``, ``position`` (gapless from 0 in a conversation),
    ``level``, ``turn``, ``call_id``, ``name``, ``status``, ``arguments`` (canonical, null if
    they are not JSON), ``errors``, ``result_turn``, ``record`` (canonical JSON).

    * ``status`` is ``linked``, ``unanswered`` (a call without result), ``early`` (the
      result stands before the call), ``repeated`` (not the first call or result of its
      identifier), ``orphan`` (a result without call) or ``cycle`` (a call that waits
      for itself).
    * First is the smallest turn, then the smallest text. Equal rows count once.
    * Numbers have no limit, and 1.0 is as whole as 1. Of members that repeat the last
      counts. A lone surrogate is kept as its escape. Texts nested beyond what
      Python follows are an error of the call.
    * The order is that of the turns where it suits all calls of a conversation,
      else that of the depth and then the turn; calls in a cycle come last. A
      reference to a call that does not exist is an error of the call, not a wait.
    * A null conversation, identifier or turn joins with nothing and comes first;
      null or empty arguments are an empty object. Other columns are not looked at.
    """
    spark = calls.sparkSession
    scratch = Scratch(spark)
    keys = ["conv_id", "call_id"]
    checked = examined(F.col("name"), F.col("arguments"), schemas)
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments").distinct()
    calls = calls.withColumn("e", checked).select(
        *keys, "turn", "name", F.col("arguments").alias("given"), "e.arguments", "e.errors", "e.refs"
    )
    calls = scratch.table(calls.withColumn("tie", F.xxhash64("name", "given")), "calls")
    results = results.select("conv_id", "call_id", "turn", "content").distinct()
    results = scratch.table(results.withColumn("tie", F.xxhash64("content")), "results")
    first = lambda df, name: df.groupBy(*keys).agg(F.min(F.struct("turn", "tie")).alias(name))
    first_calls = scratch.table(first(calls, "first_call"), "first-calls")
    first_results = scratch.table(first(results, "first_result"), "first-results")

    answers = results.join(first_results, keys).where(F.struct("turn", "tie") == F.col("first_result")).select(
        *keys, F.col("turn").alias("result_turn"), "content"
    )
    own = calls.join(first_calls.withColumnRenamed("call_id", "first_id").withColumnRenamed("conv_id", "first_conv"),
        (F.col("conv_id") == F.col("first_conv")) & (F.col("call_id") == F.col("first_id")), "left").drop("first_conv", "first_id")
    own = own.withColumn("leads", F.coalesce(F.struct("turn", "tie") == F.col("first_call"), F.lit(False)))
    repeated = own.where(~F.col("leads") & F.col("first_call").isNotNull())
    nameless = own.where(F.col("first_call").isNull())
    leading = own.where("leads")

    # References to calls of the same conversation, and those that stand the wrong way round.
    wanted = leading.select(*keys, "turn", "tie", F.explode("refs").alias("needs"))
    target = first_calls.select("conv_id", F.col("call_id").alias("needs"), F.col("first_call").alias("needed"))
    named = scratch.table(wanted.join(target, ["conv_id", "needs"], "left"), "waits")
    lost = named.where("needed is null").groupBy(*keys).agg(F.sort_array(F.collect_set("needs")).alias("lost"))
    waits = named.where("needed is not null")
    turned = waits.where(F.col("needed") >= F.struct("turn", "tie")).select("conv_id").distinct()
    turned = scratch.table(turned, "turned")
    some = leading.select(*keys).join(turned, "conv_id", "left_semi")
    levels = _depths(some, waits.join(turned, "conv_id", "left_semi").select(*keys, "needs").distinct())

    linked = (
        leading.hint("shuffle_hash")
        .join(answers, keys, "left")
        .join(scratch.table(lost, "lost"), keys, "left")
        .join(levels, keys, "left")
        .withColumn("level", F.coalesce("level", F.lit(0)))
        .withColumn(
            "errors",
            F.concat("errors", F.coalesce(F.transform("lost", lambda r: F.concat(F.lit("no call "), r)), F.array().cast("array<string>"))),
        )
        .withColumn(
            "status",
            F.when(F.col("level") == CYCLE_LEVEL, "cycle")
            .when(F.col("result_turn").isNull(), "unanswered")
            .when(F.col("result_turn") < F.col("turn"), "early")
            .otherwise("linked"),
        )
    )
    columns = ["conv_id", "level", "turn", "call_id", "name", "status", "arguments", "errors", "result_turn", "content", "tie"]
    nothing = {"result_turn": F.lit(None).cast("bigint"), "content": F.lit(None).cast("string"), "level": F.lit(0)}
    others = repeated.withColumns({**nothing, "status": F.lit("repeated")}).unionByName(
        nameless.withColumns({**nothing, "status": F.lit("unanswered")}), allowMissingColumns=True
    )
    taken = results.join(
        first_results.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "first_result"),
        (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")), "left",
    ).join(
        first_calls.select(F.col("conv_id").alias("cc"), F.col("call_id").alias("ci"), "first_call"),
        (F.col("conv_id") == F.col("cc")) & (F.col("call_id") == F.col("ci")), "left",
    )
    loose = taken.where(
        F.col("first_call").isNull() | F.col("first_result").isNull() | (F.struct("turn", "tie") != F.col("first_result"))
    ).select(
        *keys, "turn", "tie", "content",
        F.lit(0).alias("level"),
        F.lit(None).cast("string").alias("name"),
        F.when(F.col("first_call").isNull(), "orphan").otherwise("repeated").alias("status"),
        F.lit(None).cast("string").alias("arguments"),
        F.array().cast("array<string>").alias("errors"),
        F.col("turn").alias("result_turn"),
    )
    rows = linked.select(*columns).unionByName(others.select(*columns)).unionByName(loose.select(*columns))
    rows = scratch.table(
        rows.withColumn("conv", F.coalesce("conv_id", F.lit(-(2**63)))).withColumn("at", F.coalesce("turn", F.lit(-(2**63)))),
        "rows",
    )
    kind = F.xxhash64("call_id", "status")
    numbered = with_sequence(rows.withColumn("kind", kind), ("conv", "level", "at", "tie", "kind"))
    numbered = scratch.table(numbered, "numbered")
    starts = scratch.table(numbered.groupBy("conv").agg(F.min("sequence").alias("start")), "starts")
    return numbered.join(starts, "conv").select(
        "conv_id",
        (F.col("sequence") - F.col("start")).alias("position"),
        "level",
        "turn",
        "call_id",
        "name",
        "status",
        "arguments",
        "errors",
        "result_turn",
        record(*[F.col(c) for c in ("call_id", "name", "arguments", "errors", "status", "content")]).alias("record"),
    )
