"""Schemas and orders of calls against plain Python."""

import json
import random

from motifmill.llm import chat


def kind(v):
    return {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}[type(v)]


def brute(schema, v, path=""):
    out, under = set(), (lambda k: f"{path}.{k}" if path else k)
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if kind(v) not in types and not (kind(v) == "integer" and "number" in types):
            out.add(f"type: {path}")
    if "enum" in schema and not any(type(v) is type(e) and v == e for e in schema["enum"]):
        out.add(f"enum: {path}")
    if kind(v) in ("integer", "number"):
        out |= {f"minimum: {path}"} if v < schema.get("minimum", v) else set()
        out |= {f"maximum: {path}"} if v > schema.get("maximum", v) else set()
    if isinstance(v, dict):
        out |= {f"missing: {under(k)}" for k in schema.get("required", []) if k not in v}
        props = schema.get("properties", {})
        if schema.get("additionalProperties") is False:
            out |= {f"unknown: {under(k)}" for k in v if k not in props}
        for k, x in v.items():
            out |= brute(props[k], x, under(k)) if k in props else set()
    if isinstance(v, list) and "items" in schema:
        for x in v:
            out |= brute(schema["items"], x, f"{path}[]")
    return out


def random_schema(rng, depth):
    t = rng.choice(["object", "array", "integer", "string", "number", ["string", "null"], ["integer", "boolean"]] if depth else ["integer", "string", "boolean"])
    s = {"type": t} if rng.random() < 0.9 else {}
    if t == "object":
        names = rng.sample("abcd", rng.randint(1, 3))
        s |= {"properties": {k: random_schema(rng, depth - 1) for k in names}, "required": rng.sample("abcd", rng.randint(0, 2))}
        s |= {"additionalProperties": rng.random() < 0.5}
    elif t == "array":
        s["items"] = random_schema(rng, depth - 1)
    elif t in ("integer", "number"):
        s |= {"minimum": 2} if rng.random() < 0.5 else {"maximum": 7}
    elif t == "string" and rng.random() < 0.4:
        s["enum"] = ["x", "y"]
    return s


def random_value(rng, depth):
    return rng.choice([lambda: rng.randint(-2, 9), lambda: rng.choice("xyz"), lambda: None, lambda: True, lambda: rng.choice([2.5, 7.25])] + [lambda: {k: random_value(rng, depth - 1) for k in rng.sample("abcd", rng.randint(0, 4))}] * (2 * depth) + [lambda: [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]] * depth)()


def test_random_schemas(spark):
    rng = random.Random(5)
    tools = [{"type": "object"} | random_schema(rng, 3) | {"type": "object", "properties": {k: random_schema(rng, 2) for k in "abc"}} for _ in range(12)]
    calls, expected = [], {}
    for i in range(150):
        tool, value = rng.randrange(12), {k: random_value(rng, 3) for k in rng.sample("abcd", rng.randint(0, 4))}
        calls.append((i, 1, "c", f"t{tool}", json.dumps(value), []))
        expected[i] = sorted(brute(tools[tool], value))
    # of two schemas with a name the least text counts
    schemas = [(f"t{i}", json.dumps(t)) for i, t in enumerate(tools)] + [("t0", "~")]
    out = chat.link_tool_calls(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"),
        spark.createDataFrame([(i, 2, "c", "r") for i in range(150)], "conv_id long, turn long, call_id string, content string"),
        spark.createDataFrame(schemas, "name string, schema string"),
    ).collect()
    assert {r["conv_id"]: r["errors"] for r in out} == expected
    assert sum(map(bool, expected.values())) > 75 and any("[]" in e for es in expected.values() for e in es)


def test_levels(spark):
    rng = random.Random(1)
    needs = [(0, f"n{i}", f"n{i - 1}") for i in range(1, 500)]  # one long chain
    needs += [(1, f"n{i}", f"n{j}") for i in range(40) for j in {rng.randrange(i) for _ in range(min(i, 2))}]
    needs += [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "d", "c"), (2, "e", "f"), (3, "a", "a")]
    calls = sorted({(c, x) for c, *ends in needs for x in ends} | {(4, "alone")})
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in chat.levels(spark.createDataFrame(calls, "conv_id long, call_id string"), spark.createDataFrame(needs, "conv_id long, call_id string, dep string")).collect()}
    deps = {}
    for c, x, d in needs:
        deps.setdefault((c, x), []).append((c, d))
    expected = {}
    for _ in range(600):
        for k in calls:
            if k not in expected and all(d in expected for d in deps.get(k, [])):
                expected[k] = 1 + max((expected[d] for d in deps.get(k, [])), default=-1)
    assert got == {k: expected.get(k) for k in calls}
