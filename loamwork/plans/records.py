"""Queries on records: stored state, traces as JSON, configuration hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as op
from .registry import query, table


@query("trc_28_trace_records", """SELECT conv_id AS id, turn, '{"id":"t' || conv_id || '","messages":[{"role":"' || role || '","content":' || to_json(CASE WHEN turn % 3 = 0 THEN '' ELSE text END) || CASE WHEN turn % 2 = 0 THEN ',"tool_calls":[{"name":"f","arguments":"{}"}]' ELSE '' END || '}],"scores":{},"metadata":{}' || CASE WHEN turn % 4 = 0 THEN ',"timestamp":"2024"' ELSE '' END || '}' AS record FROM conversations""")
def trc_28(spark, sf):
    t = F.col("turn")
    line = F.concat(
        F.lit('{"id":"t'), F.col("conv_id").cast("string"), F.lit('","messages":[{"role":"'), "role", F.lit('"'), F.when(t % 3 == 0, "").otherwise(F.concat(F.lit(',"content":'), F.substr(F.to_json(F.struct(F.col("text").alias("t"))), F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("t")))) - 6))),
        F.when(t % 2 == 0, ',"tool_calls":[{"name":"f"}]').otherwise(',"tool_calls":[]'), F.lit("}]"), F.when(t % 4 == 0, ',"timestamp":"2024"').otherwise(',"errors":[]'), F.lit("}"),
    )
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", op.to_record(op.from_record(line)).alias("record"))


@query("ckp_02_config_hashes", """SELECT source, substr(sha256('{"hops": {"2": 0.5}, "name": "c", "total": 7}'), 1, 16) AS hash FROM documents GROUP BY source""")
def ckp_02(spark, sf):
    return table(spark, sf, "documents").select("source", F.lit(op.config_hash(total=7, name="c", hops={2: 0.5})).alias("hash")).distinct()


@query("ckp_04_stored_questions", """SELECT item_id AS id, 'q' || item_id AS question, item_id % 4 AS rounds, CASE WHEN item_id % 3 > 0 THEN 'passed' END AS status, CASE WHEN item_id % 3 > 0 THEN 'v' END AS kept, 0 AS n_history FROM benchmark""")
def ckp_04(spark, sf):
    i = F.col("item_id")
    qa = F.struct(F.concat(F.lit("q"), i.cast("string")).alias("question"))
    verdict = F.when(i % 3 > 0, F.struct(F.lit("passed").alias("status"), F.lit("ok").alias("reason"), F.lit("").alias("reasoning"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata")))
    line = op.stored(qa, F.struct((i % 4).alias("rounds")), F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<stage:string>>"), verdict)
    rows = table(spark, sf, "benchmark").select(i.alias("id"), op.restored(line, "struct<question:string>", "struct<rounds:bigint>", "struct<stage:string>").alias("r"))
    return rows.select("id", "r.qa.question", "r.metadata.rounds", "r.verdict.status", F.col("r.verdict.metadata")["k"].alias("kept"), F.size("r.history").alias("n_history"))
