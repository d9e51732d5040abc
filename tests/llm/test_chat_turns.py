import json
from collections import Counter

from motifmill.llm import chat


def texts_of(rows):
    """(conv_id, text) of all lines: a call's own text and its result, or a result's."""
    out = Counter()
    for r in rows:
        line = json.loads(r["line"])
        if r["name"]:
            a = line["arguments"]
            out[r["conv_id"], a.get("query", a.get("text"))] += 1
        if r["has_result"]:
            out[r["conv_id"], line.get("result")] += 1
    return out


def test_every_turn_has_a_row(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    out = chat.format_conversations(spark, "/root/testdata/sf0.01").collect()
    found = {(r["conv_id"], r["turn"]) for r in out} | {(r["conv_id"], r["turn"] + 1) for r in out if r["name"] and r["has_result"]}
    assert found == {(t["conv_id"], t["turn"]) for t in turns}
    assert sum(bool(r["name"]) + r["has_result"] for r in out) == len(turns)
    lost = Counter((t["conv_id"], t["text"]) for t in turns if t["role"] != "user") - texts_of(out)
    assert not lost
    system = {(t["conv_id"], t["turn"]) for t in turns if t["role"] == "system"}
    assert system and system == {(r["conv_id"], r["turn"]) for r in out if json.loads(r["line"])["id"].startswith("turn_") and r["errors"] == ["no call"]}


def test_odd_roles_and_repeats(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (1, 2, "assistant", "b"), (1, 3, None, "n"), (1, 4, "tool", "t"), (1, 5, "User", "x"), (1, 6, "tool", None), (None, 1, "system", "z"), (None, 2, "assistant", "y")]
    calls, results = chat.calls_of_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    out = chat.link_tool_calls(calls, results, spark.createDataFrame(chat.TOOLS, "name string, schema string")).collect()
    assert len(out) == len(turns) - 1
    lines = Counter((r["conv_id"], json.loads(r["line"]).get("result")) for r in out if r["has_result"])
    assert lines == Counter((c, text) for c, _, role, text in turns if role != "user")
    (call,) = [r for r in out if r["name"]]
    assert json.loads(call["line"])["result"] == "a" and not any("duplicate" in e for e in call["errors"])


def test_clashing_names(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(60)
    more = turns.selectExpr("*", "'x' as name", "1 as call_id", "2 as level", "'y' as line", "'z' as result", "3 as errors", "4 as arguments", "5 as n")
    schemas = spark.createDataFrame(chat.TOOLS, "name string, schema string")
    plain, found = ([tuple(r) for r in chat.link_tool_calls(*chat.calls_of_turns(t), schemas).select("conv_id", "turn", "line", "errors").collect()] for t in (turns, more))
    assert plain and sorted(map(str, plain)) == sorted(map(str, found))
