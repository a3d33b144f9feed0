"""Queries on spans: a conversation is a trace, each of its turns a span in one of several JSON layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spans as op
from .registry import query, table


def spans(spark, sf):
    """Spans as JSON: a root per conversation (every fifth holds the whole talk), a child per turn."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("trace"), "turn", "text")
    quoted = F.to_json(F.struct(F.col("text").alias("t")))
    c = c.withColumn("q", F.substr(quoted, F.lit(6), F.length(quoted) - 6))
    user, bot = F.concat(F.lit('{"role":"user","content":'), F.col("q"), F.lit("}")), F.concat(F.lit('{"content":'), F.col("q"), F.lit("}"))
    root = F.when(F.col("trace") % 5 == 0, F.concat(F.lit("["), user, F.lit(","), bot, F.lit("]"))).otherwise(F.concat(F.lit('{"messages":['), user, F.lit("]}")))
    roots = c.where("turn = 0").select("trace", F.lit(-1).alias("seq"), F.lit("").alias("span_id"), F.lit("r").alias("id"), F.lit(True).alias("root"), F.lit("0").alias("created"), F.lit("").alias("name"), F.lit("task").alias("kind"), root.alias("input"), F.lit(None).cast("string").alias("output"))
    kind = F.when((F.col("trace") % 5 == 1), "step").when(F.col("turn") % 3 == 0, "llm").when(F.col("turn") % 3 == 1, "tool").otherwise("step")
    asked = F.when(F.col("turn") < 6, F.concat(F.lit('{"messages":['), user, F.lit(',{"role":"system","content":"rules"}]}'))).otherwise(F.lit('{"messages":[]}'))
    call = F.lit(',"tool_calls":[{"id":"c1","function":{"name":"find","arguments":{"k":1}}},{"name":"open","arguments":"{}"},3]}')
    out = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('{"role":"assistant","content":'), F.col("q"), call)).when(F.col("turn") % 4 == 1, F.concat(F.lit('{"result":'), F.col("q"), F.lit("}")))
    out = out.when(F.col("turn") % 4 == 2, F.concat(F.lit('{"messages":['), user, F.lit(',{"role":"assistant","content":7}]}'))).otherwise(F.col("q"))
    kids = c.select("trace", (100 - F.col("turn")).cast("int").alias("seq"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("s"), F.col("turn").cast("string"))).otherwise("").alias("span_id"), F.concat(F.lit("i"), F.col("turn").cast("string")).alias("id"), F.lit(False).alias("root"), F.col("turn").cast("string").alias("created"), F.lit("grep").alias("name"), kind.alias("kind"), asked.alias("input"), out.alias("output"))
    return roots.union(kids)


CONV = """cv AS (SELECT conv_id AS trace, turn, text, CASE WHEN conv_id % 5 = 1 THEN 'step' WHEN turn % 3 = 0 THEN 'llm' WHEN turn % 3 = 1 THEN 'tool' ELSE 'step' END AS kind FROM conversations),
said AS (SELECT trace, turn, 0 AS k, CASE WHEN turn % 4 = 2 THEN 'user' ELSE 'assistant' END AS role, text AS content, CASE WHEN turn % 4 = 0 THEN 'find{"k":1}c1;open{}' ELSE '' END AS calls FROM cv WHERE turn % 4 <> 1 UNION ALL SELECT trace, turn, 1, 'assistant', '7', '' FROM cv WHERE turn % 4 = 2),
answer AS (SELECT trace, turn, 0 AS k, 'tool' AS role, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '{"messages":[{"content":' || to_json(text) || ',"role":"user"},{"content":7,"role":"assistant"}]}' ELSE text END AS content, '' AS calls, CASE WHEN turn % 2 = 0 THEN 's' || turn ELSE 'i' || turn END AS call_id FROM cv),
one AS (SELECT trace, 1 AS strategy, unnest([0, 1]) AS o, unnest(['user', 'assistant']) AS role, text AS content, '' AS calls, NULL AS call_id, NULL AS name FROM cv WHERE turn = 0 AND trace % 5 = 0),
late AS (SELECT trace, turn, k, role, content, calls, NULL AS call_id, NULL AS name FROM said JOIN cv USING (trace, turn) WHERE kind <> 'tool' AND turn > 0 UNION ALL SELECT trace, turn, k, role, content, calls, call_id, 'grep' FROM answer JOIN cv USING (trace, turn) WHERE kind = 'tool' AND turn > 0),
fresh AS (SELECT * FROM late l WHERE content <> 'rules' AND content <> (SELECT text FROM cv WHERE cv.trace = l.trace AND turn = 0) QUALIFY row_number() OVER (PARTITION BY trace, content ORDER BY turn, k) = 1),
two AS (SELECT trace, 0 AS o, 'user' AS role, text AS content, '' AS calls, NULL AS call_id, NULL AS name FROM cv WHERE turn = 0 UNION ALL SELECT trace, 1, 'system', 'rules', '', NULL, NULL FROM cv WHERE turn = 0 UNION ALL SELECT trace, 2, role, content, calls, NULL, NULL FROM said WHERE turn = 0
 UNION ALL SELECT trace, 10 + turn * 2 + k, role, content, calls, call_id, name FROM fresh),
three AS (SELECT trace, 0 AS o, 'user' AS role, text AS content, '' AS calls, NULL AS call_id, NULL AS name FROM cv WHERE turn = 0 UNION ALL SELECT trace, 10 + turn * 2 + k, role, content, calls, NULL, NULL FROM said),
ms AS (SELECT trace, strategy, o, role, content, calls, call_id, name FROM one UNION ALL SELECT trace, 2, o, role, content, calls, call_id, name FROM two WHERE trace % 5 > 1 UNION ALL SELECT trace, 3, o, role, content, calls, call_id, name FROM three WHERE trace % 5 = 1)"""


@query("trc_17_trace_messages", f"WITH {CONV} SELECT trace, strategy::INT AS strategy, (row_number() OVER (PARTITION BY trace ORDER BY o) - 1)::INT AS place, role, md5(content) AS content, calls, call_id, name FROM ms")
def trc_17(spark, sf):
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat(c["name"], c["arguments"], F.coalesce(c["id"], F.lit("")))), ";")
    return op.trace_messages(spans(spark, sf)).select("trace", "strategy", "place", "role", F.md5("content").alias("content"), calls.alias("calls"), F.col("tool_call_id").alias("call_id"), "name")


@query("trc_18_output_messages", "WITH " + CONV + " SELECT trace, turn, k AS place, role, md5(content) AS content, calls FROM said")
def trc_18(spark, sf):
    rows = spans(spark, sf).where("NOT root").select("trace", F.col("created").cast("int").alias("turn"), F.posexplode(op.output_messages("output")).alias("place", "m"))
    calls = F.array_join(F.transform("m.tool_calls", lambda c: F.concat(c["name"], c["arguments"], F.coalesce(c["id"], F.lit("")))), ";")
    return rows.select("trace", "turn", "place", "m.role", F.md5("m.content").alias("content"), calls.alias("calls"))


@query("trc_26_normalised_traces", f"WITH {CONV} SELECT trace, '0' AS created, count(*) AS n_messages, NULL::VARCHAR AS error FROM ms WHERE trace % 7 > 0 GROUP BY trace UNION ALL SELECT trace, '0', 0, 'Message extraction failed: 1 payloads are no JSON' FROM cv WHERE turn = 0 AND trace % 7 = 0")
def trc_26(spark, sf):
    broken = spans(spark, sf).withColumn("output", F.when((F.col("trace") % 7 == 0) & (F.col("created") == "0") & ~F.col("root"), "{oops").otherwise(F.col("output")))
    return op.normalised(broken).select("trace", "created", F.col("n_messages").cast("bigint").alias("n_messages"), F.get("errors", F.lit(0)).alias("error"))


@query("trc_27_tool_responses", f"WITH {CONV} SELECT trace, turn, md5(content) AS content, call_id FROM answer")
def trc_27(spark, sf):
    call = F.coalesce(F.nullif("span_id", F.lit("")), "id")
    rows = spans(spark, sf).where("NOT root").select("trace", F.col("created").cast("int").alias("turn"), F.explode(op.tool_response("output", F.col("name"), call)).alias("m"))
    # A whole object has its keys in the order of their names.
    return rows.select("trace", "turn", F.md5("m.content").alias("content"), F.col("m.tool_call_id").alias("call_id"))
