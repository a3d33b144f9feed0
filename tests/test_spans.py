import json

import pytest

from loamwork.operators import spans as op

SCHEMA = "trace string, seq int, span_id string, id string, root boolean, created string, name string, kind string, input string, output string"


def messages(spark, column, payload):
    df = spark.createDataFrame([(payload,)], "p string")
    (row,) = df.select(column("p").alias("m")).collect()
    return [(m.role, m.content, [(c.name, c.arguments, c.id) for c in m.tool_calls]) for m in row.m]


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        (None, []),
        ("", []),
        ("{broken", []),
        ('""', []),
        ("3", []),
        ('"hi"', [("assistant", "hi", [])]),
        ('{"role":"user","content":null}', [("user", "", [])]),
        ('{"messages":[{"content":"a"},"no",{"role":"tool","content":{"b":[1,2]}}]}', [("assistant", "a", []), ("tool", '{"b":[1,2]}', [])]),
        ('{"content":"x"}', [("assistant", "x", [])]),
        ('{"content":""}', []),
        ('[{"content":true}]', [("assistant", "true", [])]),
        ('{"role":"assistant","id":"m","function":{"name":"f"}}', [("assistant", "", [("f", "{}", "m")])]),
        ('{"role":"assistant","tool_calls":[],"function":{"name":"f","arguments":{"a":"b"}}}', [("assistant", "", [("f", '{"a":"b"}', None)])]),
        ('{"role":"assistant","tool_calls":[{"id":"1","function":{"name":"g","arguments":"{}"}},{"name":"h"},7,{"x":1}]}', [("assistant", "", [("g", "{}", "1"), ("h", "{}", None)])]),
        ('{"role":"assistant","tool_calls":"odd"}', [("assistant", "", [])]),
    ],
)
def test_output_layouts(spark, payload, want):
    assert messages(spark, op.output_messages, payload) == want


def test_input_layouts(spark):
    assert messages(spark, op.input_messages, '[{"role":"user","content":"a"}]') == [("user", "a", [])]
    assert messages(spark, op.input_messages, '{"messages":"none"}') == messages(spark, op.input_messages, '"x"') == []


def talk(spark, rows):
    df = spark.createDataFrame([("t", k, *r) for k, r in enumerate(rows)], SCHEMA)
    return [(r.strategy, r.role, r.content, r.tool_call_id) for r in op.trace_messages(df).orderBy("place").collect()]


def test_three_strategies(spark):
    j = json.dumps
    user, bot = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}
    root = ("", "r", True, "0", "", "task")
    assert talk(spark, [(*root, j([user, bot]), None), ("s", "i", False, "1", "", "llm", j([user]), j("late"))]) == [(1, "user", "q", None), (1, "assistant", "a", None)]
    kids = [
        ("s3", "", False, "3", "grep", "tool", None, j({"result": "found"})),
        ("s1", "", False, "1", "", "llm", j([user]), j("early")),
        ("s2", "", False, "2", "", "llm", j([user, {"role": "user", "content": "more"}]), j("a")),
        ("s4", "", False, "4", "", "step", None, j([bot, {"role": "assistant", "content": "more"}])),
        ("s5", "", False, "5", "", "step", None, j("found")),
        ("", "i6", False, "5", "", "tool", None, j({"x": 1})),
        ("s7", "", False, "6", "", "tool", None, None),
    ]
    want = [(2, "user", "q", None), (2, "user", "more", None), (2, "assistant", "a", None), (2, "tool", "found", "s3"), (2, "assistant", "a", None), (2, "tool", '{"x":1}', "i6")]
    assert talk(spark, [(*root, j({"messages": [user]}), None), *kids]) == want
    assert talk(spark, [(*root, j([user]), None), ("s", "", False, "1", "", "tool", None, j({"content": "c"}))]) == [(3, "user", "q", None), (3, "assistant", "c", None)]
    assert talk(spark, [("s", "", False, "1", "", "llm", j([user, bot]), j("a"))]) == []


def test_broken_payloads_are_errors(spark):
    rows = [("t", 0, "", "", True, "0", "", "", '"x"', '"y"'), ("t", 1, "", "", False, "1", "", "llm", "[{", '"z"'), ("u", 2, "", "", True, "5", "", "", None, None), ("v", 3, "", "", False, "5", "", "", None, None)]
    got = {r.trace: (r.created, r.n_messages, r.errors) for r in op.normalised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"t": ("0", 0, ["Message extraction failed: 1 payloads are no JSON"]), "u": ("5", 0, None)}
