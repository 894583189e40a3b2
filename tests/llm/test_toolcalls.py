import json
import random

import pytest
from pyspark.sql import functions as F

from weirlog.llm import toolcalls
from weirlog.llm.catalog import QUERIES, SCHEMAS, tool_messages

SF = "/root/testdata/sf0.001"
TOOLS = {
    "add": {
        "type": "object",
        "properties": {
            "a": {"type": "number", "minimum": 0, "maximum": 9},
            "b": {"type": ["integer", "null"]},
            "tags": {"type": "array", "items": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 3}},
            "mode": {"enum": ["x", 1]},
        },
        "required": ["a"],
        "additionalProperties": False,
    }
}


@pytest.mark.parametrize(
    "text, arguments, errors",
    [
        ('{"b": null, "a": 1.50}', '{"a":1.5,"b":null}', []),
        ('{"a": 12, "c": 1}', '{"a":12,"c":1}', ["/c: unknown", "/a: out of range"]),
        ('{"a": true}', '{"a":true}', ["/a: not number"]),
        ('{"b": 1.5}', '{"b":1.5}', ["/a: missing", "/b: not integer or null"]),
        ('{"a": 0, "tags": ["ok", "NO", "long"], "mode": "y"}', '{"a":0,"mode":"y","tags":["ok","NO","long"]}',
         ["/mode: not one of the choices", "/tags/1: wrong pattern", "/tags/2: wrong length"]),
        ('{"a": {"$ref": "q"}}', '{"a":{"$ref":"q"}}', []),
        ("[1]", "[1]", ["/: not object"]),
        ("{", None, ["not JSON"]),
        ('{"a": NaN}', None, ["not JSON"]),
        ("", "{}", ["/a: missing"]),
        (None, "{}", ["/a: missing"]),
        ('{"a": 1, "tags": ["é\\u00e9"]}', '{"a":1,"tags":["éé"]}', ["/tags/0: wrong pattern"]),
        ("[" * 100_000, None, ["nested too deeply"]),
        ('{"a": "\\ud800"}', '{"a":"\\ud800"}', ["/a: not number"]),
        ('{"\\udc00": 1, "a": 1}', '{"a":1,"\\udc00":1}', ["/\\udc00: unknown"]),
        ('{"a": 1e400}', '{"a":1E+400}', ["/a: out of range"]),
        ('{"a": 1e-400}', '{"a":1E-400}', []),
        ('{"a": 1.0, "b": 3.0}', '{"a":1.0,"b":3.0}', []),
        ('{"a": 1, "b": ' + "7" * 5000 + "}", '{"a":1,"b":' + "7" * 5000 + "}", []),
        ('{"a": 1, "b": 1e400}', '{"a":1,"b":1E+400}', []),
        ('{"a": 1, "b": 25e-401}', '{"a":1,"b":2.5E-400}', ["/b: not integer or null"]),
        ('{"a": 1, "mode": true}', '{"a":1,"mode":true}', ["/mode: not one of the choices"]),
        ('{"a": 9, "a": 1, "mode": 1.0}', '{"a":1,"mode":1.0}', []),
    ],
)
def test_arguments(text, arguments, errors):
    found = toolcalls.examine("add", text, TOOLS)
    assert (found["arguments"], found["errors"]) == (arguments, errors)


def brute(calls, results, schemas):
    """Conversation by conversation, with dictionaries."""
    calls = list(dict.fromkeys(calls))
    results = list(dict.fromkeys(results))
    small = lambda x: (x is not None, x)
    out = []
    for conv in {c[0] for c in calls} | {r[0] for r in results}:
        mine = [c for c in calls if c[0] == conv]
        got = [r for r in results if r[0] == conv]
        lead, rows = {}, []
        for c in mine:
            if conv is not None and c[1] is not None and (c[1] not in lead or small(c[2]) < small(lead[c[1]][2])):
                lead[c[1]] = c
        answer = {}
        for r in got:
            if conv is not None and r[1] is not None and (r[1] not in answer or small(r[2]) < small(answer[r[1]][2])):
                answer[r[1]] = r
        info = {i: toolcalls.examine(c[3], c[4], schemas) for i, c in lead.items()}
        needs = {i: [n for n in info[i]["refs"] if n in lead] for i in lead}
        fits = all(small(lead[n][2]) < small(lead[i][2]) for i in lead for n in needs[i])
        level = {i: 0 for i in lead} if fits else {}
        while not fits:
            ready = [i for i in lead if i not in level and all(n in level for n in needs[i])]
            if not ready:
                break
            level.update({i: max((level[n] + 1 for n in needs[i]), default=0) for i in ready})
        for c in mine:
            i = c[1]
            e = toolcalls.examine(c[3], c[4], schemas)
            if i is None or conv is None:
                rows.append((0, c[2], i, c[3], "unanswered", e["arguments"], e["errors"], None, None))
            elif lead[i] != c:
                rows.append((0, c[2], i, c[3], "repeated", e["arguments"], e["errors"], None, None))
            else:
                errors = e["errors"] + [f"no call {n}" for n in sorted(e["refs"]) if n not in lead]
                r = answer.get(i)
                lv = level.get(i, toolcalls.CYCLE_LEVEL)
                status = (
                    "cycle" if lv == toolcalls.CYCLE_LEVEL else "unanswered" if r is None else "early" if r[2] < c[2] else "linked"
                )
                rows.append((lv, c[2], i, c[3], status, e["arguments"], errors, r and r[2], r and r[3]))
        for r in got:
            if r[1] not in lead:
                rows.append((0, r[2], r[1], None, "orphan", None, [], r[2], r[3]))
            elif answer[r[1]] != r:
                rows.append((0, r[2], r[1], None, "repeated", None, [], r[2], r[3]))
        for lv, turn, i, name, status, arguments, errors, at, content in rows:
            record = toolcalls.canonical(
                {"id": i, "name": name, "arguments": None if arguments is None else json.loads(arguments),
                 "errors": errors, "status": status, "result": content}
            )
            out.append((conv, lv, turn, i, name, status, arguments, errors, at, record))
    return out


def check(spark, calls, results, schemas):
    c = spark.createDataFrame(calls, "conv_id bigint, call_id string, turn bigint, name string, arguments string")
    r = spark.createDataFrame(results, "conv_id bigint, call_id string, turn bigint, content string")
    clash = F.lit("clash")
    rows = toolcalls.link_calls(c.withColumn("refs", clash).withColumn("level", clash), r.withColumn("status", clash), schemas).collect()
    got = [(x.conv_id, x.level, x.turn, x.call_id, x.name, x.status, x.arguments, x.errors, x.result_turn, x.record) for x in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(calls, results, schemas)))
    by = {}
    for x in rows:
        by.setdefault(x.conv_id, []).append(x)
    for mine in by.values():
        assert sorted(x.position for x in mine) == list(range(len(mine)))
        # Each call stands behind the calls it names.
        place = {x.call_id: x.position for x in mine if x.status in ("linked", "unanswered", "early") and x.call_id}
        for x in mine:
            if x.call_id in place and place[x.call_id] == x.position and x.arguments:
                for n in toolcalls.references(json.loads(x.arguments)):
                    assert n not in place or place[n] < x.position
    return rows


def test_awkward_conversations(spark):
    ref = lambda *ids: json.dumps({"a": [{"$ref": i} for i in ids]})
    calls = [
        (1, "a", 1, "add", '{"a": 1}'), (1, "b", 3, "add", ref("a")), (1, "b", 5, "add", "{}"), (1, "c", 7, "none", ref("zz", "a")),
        (2, "a", 1, "add", ref("b")), (2, "b", 3, "add", ref("c")), (2, "c", 5, "add", '{"a": 2}'), (2, "d", 7, "add", "oops"),
        (3, "a", 1, "add", ref("b")), (3, "b", 3, "add", ref("a")), (3, "c", 5, "add", ref("a")), (3, "d", 6, "add", "{}"),
        (4, "self", 2, "add", ref("self")),
        (5, "late", 9, "add", '{"a": 3}'),
        (None, "a", 1, "add", "{}"), (6, None, 1, None, None), (6, "x", None, "add", "{}"),
    ]
    results = [
        (1, "a", 2, "one"), (1, "a", 4, "again"), (1, "q", 4, "nobody asked"), (2, "a", 2, None), (2, "c", 6, ""),
        (3, "d", 7, "é \u0001 \"quoted\""), (5, "late", 8, "before"), (None, "a", 2, "x"), (6, None, 2, "y"),
    ]
    check(spark, calls + calls[:2], results + results[:1], TOOLS)


def test_a_conversation_that_holds_most_rows(spark):
    draw = random.Random(2)
    calls, results = [], []
    for t in range(400):
        refs = [{"$ref": f"c{draw.randint(max(0, t - 20), t - 1)}"} for _ in range(2)] if t % 9 and t else []
        calls.append((7, f"c{t}", 2 * t, "add", json.dumps({"a": t % 12, "tags": refs})))
        if t % 5:
            results.append((7, f"c{t}", 2 * t + 1, f"r{t}"))
    check(spark, calls + [(8, "a", 0, "add", "{}")], results, TOOLS)


def test_empty_tables(spark):
    assert check(spark, [], [], TOOLS) == []
    check(spark, [], [(1, "a", 1, "x")], TOOLS)
    check(spark, [(1, "a", 1, "add", "{}")], [], TOOLS)


def test_query(spark):
    calls, results = tool_messages(spark, SF)
    expected = brute([tuple(c) for c in calls.collect()], [tuple(r) for r in results.collect()], SCHEMAS)
    rows = QUERIES["op1_tool_calls"](spark, SF).collect()
    got = [(x.conv_id, x.level, x.turn, x.call_id, x.name, x.status, x.arguments, x.errors, x.result_turn, x.record) for x in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert {x.status for x in rows} >= {"linked", "orphan"} and any(x.errors for x in rows) and any(x.level for x in rows)


@pytest.mark.parametrize("limit", [10**9, 0])
def test_chains_and_cycles(spark, monkeypatch, limit):
    """A chain against its turns, one that ends in a cycle, and awkward JSON, in one task and by rounds."""
    monkeypatch.setattr(toolcalls, "MAX_WAITS", limit)
    n = 2000 if limit else 6
    ref = lambda *ids: json.dumps({"x": [{"$ref": i} for i in ids]})
    calls = [(1, f"c{i}", n - i, "t", ref(f"c{i - 1}") if i else "{}") for i in range(n)]
    calls += [(2, "p", 1, "t", ref("q")), (2, "q", 2, "t", ref("p")), (2, "r", 3, "t", ref("q", "s")), (2, "s", 4, "t", "{}")]
    calls += [(3, "u", 1, "t", '{"y": "\\ud800", "z": 1e400}'), (3, "v", 2, "t", '{"$ref": "\\ud800"}')]
    df = spark.createDataFrame(calls, "conv_id bigint, call_id string, turn bigint, name string, arguments string")
    none = spark.createDataFrame([(3, "u", 2, "fine \u00e9")], "conv_id bigint, call_id string, turn bigint, content string")
    rows = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link_calls(df, none, {"t": {}}).collect()}
    assert [rows[1, f"c{i}"]["level"] for i in range(n)] == list(range(n))
    assert [rows[1, f"c{i}"]["position"] for i in range(n)] == list(range(n))
    last = toolcalls.CYCLE_LEVEL
    assert [rows[2, c]["level"] for c in "pqrs"] == [last, last, last, 0]
    assert rows[3, "u"]["record"] == (
        '{"arguments":{"y":"\\ud800","z":1E+400},"errors":[],"id":"u","name":"t","result":"fine \u00e9","status":"linked"}'
    )
    assert rows[3, "v"]["errors"] == ["no call \\ud800"]
