"""Queries on planning, prompting, judging and refining, with deterministic stand-ins for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generation as op
from .registry import query, table


def items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


@query("qaf_03_next_tasks", """SELECT 'iter_4_' || lpad(n::VARCHAR, 5, '0') AS task_id, CASE WHEN n < 6 THEN 'lookup' ELSE 'multi_hop' END AS qa_type FROM (SELECT unnest(generate_series(0, 19)) AS n)""")
def qaf_03(spark, sf):
    counts = op.plan_batch({"lookup": 10, "multi_hop": 30}, {"lookup": 1, "multi_hop": 5}, {"lookup": 0.3, "multi_hop": 0.7}, 20)
    seeds = table(spark, sf, "documents").where("length(text) >= 400").select(F.col("doc_id").alias("id"))
    return op.next_tasks(spark, seeds, counts=counts, modes={"factual": 3.0, "temporal": 1.0}, hops={"2": 0.5, "3": 0.5}, iteration=4).select("task_id", "qa_type")


@query("qaf_04_templates", "SELECT item_id AS id, md5('Q {' || item_id || '} ' || CASE WHEN item_id % 3 > 0 THEN 'kind: k' || item_id % 3 || CASE WHEN item_id % 2 = 0 THEN ' (even)' ELSE '' END ELSE '' END || '!' || text) AS prompt FROM benchmark")
def qaf_04(spark, sf):
    i = F.col("id")
    text = op.template("Q {{{id}}} [[if kind]]kind: {kind}[[if even]] (even)[[endif]][[endif]]!{text}", {"id": i, "kind": F.when(i % 3 > 0, F.concat(F.lit("k"), (i % 3).cast("string"))), "even": F.when(i % 2 == 0, "yes").otherwise(" "), "text": F.col("text")})
    return items(spark, sf).select("id", F.md5(text).alias("prompt"))


@query("qaf_05_prepared_tasks", """WITH t AS (SELECT doc_id AS task_id, (doc_id % 4 + 1)::INT AS hops, [doc_id, doc_id + 1, doc_id + 2, doc_id + 3, doc_id + 4] AS s FROM documents), x AS (SELECT task_id, hops, s[1] AS own, list_filter(list_slice(s, 1, 4), lambda y: y % 7 IN (1, 2))[1] AS good FROM t)
SELECT task_id, CASE WHEN hops > 1 AND good IS NULL THEN 'lookup' WHEN hops > 1 THEN 'multi_hop' ELSE 'lookup' END AS qa_type, CASE WHEN hops > 1 AND good IS NOT NULL THEN least(hops, good % 7 + 1) ELSE 1 END::INT AS hops, CASE WHEN hops > 1 AND good IS NOT NULL THEN good ELSE own END AS seed_id, CASE WHEN hops > 1 AND good IS NOT NULL THEN good % 7 ELSE 0 END::INT AS found FROM x""")
def qaf_05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    hops = (F.col("doc_id") % 4 + 1).cast("int")
    tasks = d.select(F.col("doc_id").alias("task_id"), F.when(hops > 1, "multi_hop").otherwise("lookup").alias("qa_type"), hops.alias("hops"), F.sequence(F.col("doc_id"), F.col("doc_id") + 4).alias("seeds"))
    ids = d.union(d.agg(F.max("doc_id").alias("m")).select(F.explode(F.sequence(F.col("m") + 1, F.col("m") + 4))))
    return op.prepare(tasks, ids.where("doc_id % 7 IN (1, 2)").select(F.col("doc_id").alias("seed_id"), (F.col("doc_id") % 7).cast("int").alias("found")))


def answers(prompt: str) -> str:
    """A stand-in for a model: fails on some prompts, refuses others."""
    if prompt.endswith("0"):
        raise ValueError("refused")
    return "cannot_generate" if prompt.endswith("1") else f'{{"question": "What of {prompt}?", "answer": "{prompt}"}}'


@query("qaf_06_generated", "SELECT item_id AS id, CASE WHEN item_id % 10 > 1 THEN 'What of p' || item_id || '?' END AS question, CASE WHEN item_id % 10 > 1 THEN 'p' || item_id END AS answer FROM benchmark")
def qaf_06(spark, sf):
    rows = items(spark, sf).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    return op.generate(rows, "prompt", answers).select("id", "question", "answer")


VERDICT = "CASE WHEN event_id % 11 = 0 THEN 'missing_question' WHEN event_id % 3 = 0 AND event_id % 5 >= event_id % 4 THEN 'env_filter_passed' WHEN event_id % 3 = 0 THEN 'too_easy' ELSE 'incorrect_or_unresolved' END"


@query("qaf_19_rollout_verdicts", f"SELECT event_id, {VERDICT} AS reason_code, CASE {VERDICT} WHEN 'env_filter_passed' THEN 'passed' WHEN 'missing_question' THEN 'rejected' ELSE CASE WHEN event_id % 4 < 2 THEN 'needs_refinement' ELSE 'rejected' END END AS status FROM events")
def qaf_19(spark, sf):
    i = F.col("event_id")
    v = op.rollout_verdict(F.when(i % 11 == 0, " ").otherwise("q"), i % 3 == 0, i % 5, i % 4, i % 4)
    return table(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", "v.*")


@query("qaf_22_refinement", """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 4 THEN 'bad' WHEN doc_id % 5 > 2 THEN 'refinement_budget_exhausted' ELSE 'ok' END AS reason, CASE WHEN doc_id % 5 > 2 THEN 'rejected' ELSE 'passed' END AS status, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE least(doc_id % 5, 2) END::INT AS rounds, doc_id % 5 = 3 OR doc_id % 5 IN (1, 2) AS changed FROM documents""")
def qaf_22(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("q").alias("question"))
    want = F.col("id") % 5

    def judge(some):
        tries = F.length("question") - 1
        status = F.when(want == 4, "rejected").when(tries >= want, "passed").otherwise("needs_refinement")
        return some.withColumn("status", status).withColumn("reason", F.when(want == 4, "bad").when(tries >= want, "ok").otherwise("more"))

    found = op.refine(rows, judge, lambda some: some.withColumn("question", F.concat("question", F.lit("+"))), 2)
    return found.select("id", "status", "reason", "rounds", (F.length("question") > 1).alias("changed"))


@query("qaf_31_transformed", "SELECT item_id AS id, md5(CASE WHEN item_id % 3 = 0 THEN trim(text) ELSE lower(trim(text)) END) AS question, item_id % 3 > 0 AND lower(trim(text)) <> trim(text) AS changed, CASE WHEN item_id % 3 = 0 THEN 'plain' ELSE 'lower' END AS style FROM benchmark")
def qaf_31(spark, sf):
    t = op.transformed(F.col("text"), F.when(F.col("id") % 3 > 0, F.lower("text")), lambda q: F.when(q == F.lower(q), "lower").otherwise("plain"))
    return items(spark, sf).select("id", t.alias("t")).select("id", F.md5("t.question").alias("question"), "t.changed", "t.style")


@query("qaf_36_rejections", """SELECT item_id AS id, '{"status":"rejected","reason":"duplicate","reasoning":"duplicate","metadata":{"filter_mode":"pipeline","reason_code":"dup","original_filter_status":"passed","original_filter_reason":"r' || item_id % 3 || '","original_filter_reasoning":"w","original_filter_metadata":{"k":"v"}}}' AS verdict FROM benchmark""")
def qaf_36(spark, sf):
    old = F.struct(F.lit("passed").alias("status"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("reason"), F.lit("w").alias("reasoning"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    return items(spark, sf).select("id", F.to_json(op.rejected(old, F.lit("duplicate"), F.lit("dup"))).alias("verdict"))


@query("qaf_37_regeneration_prompts", r"""SELECT item_id AS id, md5('Regeneration instructions:' || chr(10) || '- source_task_id: t' || item_id || chr(10) || '- attempt: 2' || chr(10) || '- previous_filter_reason_code: unknown' || chr(10) || '- previous_failure_type: too_easy' || chr(10) || '- previous_judge_reason_tag: tag' || chr(10) || '- overlap_triggered: true' || chr(10) || '- expected_action: harder' || chr(10)
 || CASE WHEN item_id % 2 = 0 THEN '- previous_refinement_hint: hint' || chr(10) ELSE '' END || '- reanchor_action: ' || CASE WHEN item_id % 3 = 0 THEN 'switched seed chunk after repeated failures (a -> b)' ELSE 'keep same seed chunk (b)' END || chr(10) || 'Previous QA to improve:' || chr(10) || '- question: ' || CASE WHEN length(trim(text)) > 420 THEN substr(trim(text), 1, 417) || '...' ELSE trim(text) END || chr(10)
 || '- answer: ' || CASE WHEN length(trim(text)) > 520 THEN substr(trim(text), 1, 517) || '...' ELSE trim(text) END || chr(10) || 'Rewrite the QA to address the failure reason while staying grounded in the provided primary/secondary chunks for this attempt.') AS prompt FROM benchmark""")
def qaf_37(spark, sf):
    i, none = F.col("id"), F.lit(None).cast("string")
    fields = {"task": F.concat(F.lit("t"), i.cast("string")), "attempt": F.lit("2"), "code": F.lit(" "), "failure": F.lit("too_easy"), "tag": F.lit("tag"), "overlap": F.lit("true"), "action": F.lit("harder"), "reasoning": none, "hint": F.when(i % 2 == 0, "hint"), "judge_reasoning": F.lit(""), "evidence": none, "old_seed": F.lit("a"), "new_seed": F.lit("b"), "question": F.col("text"), "answer": F.col("text")}
    return items(spark, sf).select("id", F.md5(op.regeneration_prompt(fields, i % 3 == 0)).alias("prompt"))


@query("qaf_38_exported", """SELECT 'q' || item_id AS question, 'a' AS answer, 'lookup' AS qa_type, 1 AS min_hop_count, 1 AS n_events, 'passed' AS status, 'ok' AS reason, '{"c":' || item_id || '}' AS verdict_metadata FROM benchmark""")
def qaf_38(spark, sf):
    i = F.col("id")
    qa = op.qa_row(F.concat(F.lit("q"), i.cast("string")), F.lit("a"), F.lit("lookup"), F.lit(1), F.array(F.lit("r")))
    verdict = F.struct(F.lit("passed").alias("status"), F.lit("ok").alias("reason"), F.lit("").alias("reasoning"), F.struct(i.alias("c")).alias("metadata"))
    events = op.record(F.lit(None), op.event("generator", "generated", F.lit("lookup"), F.lit("lookup"), F.struct(F.lit(1).alias("x"))))
    rows = op.exported(items(spark, sf).select(qa.alias("qa"), events.alias("events"), F.create_map().alias("metadata"), verdict.alias("verdict")))
    return rows.select("question", "answer", "qa_type", "min_hop_count", F.size("journey_events").alias("n_events"), "status", "reason", "verdict_metadata")


@query("qaf_39_reference_ids", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'h' || doc_id WHEN 1 THEN 'i' WHEN 2 THEN source WHEN 3 THEN 'd' ELSE substr(text, 1, 80) END AS id FROM documents")
def qaf_39(spark, sf):
    k = F.col("doc_id") % 5
    metadata = F.create_map(F.lit("id"), F.when(k == 1, "i").otherwise(""), F.lit("file"), F.when(k == 2, F.col("source")), F.lit("document_id"), F.when(k == 3, "d"))
    return table(spark, sf, "documents").select("doc_id", op.reference_id(F.col("text"), F.when(k == 0, F.concat(F.lit("h"), F.col("doc_id").cast("string"))), metadata).alias("id"))


@query("qaf_47_journey_events", """SELECT item_id AS id, '[{"stage":"generator","event_type":"generated","qa_type_before":"lookup","qa_type_after":"lookup","reason_code":"","details":"{\\"mode\\":\\"m\\"}"},{"stage":"filter","event_type":"filter_rejected","qa_type_before":"lookup","qa_type_after":"lookup","reason_code":"c' || item_id % 2 || '","details":"{\\"filter_reason\\":\\"r\\"}"}]' AS events FROM benchmark""")
def qaf_47(spark, sf):
    lookup = F.lit("lookup")
    first = op.record(F.lit(None), op.event("generator", "generated", lookup, lookup, F.struct(F.lit("m").alias("mode"))))
    both = op.record(first, op.event("filter", "filter_rejected", lookup, lookup, F.struct(F.lit("r").alias("filter_reason")), F.concat(F.lit("c"), (F.col("id") % 2).cast("string"))))
    return items(spark, sf).select("id", F.to_json(both).alias("events"))


@query("qaf_48_rollout_judges", """SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'A' || item_id ELSE 'plain' END AS answer, (item_id % 3)::INT AS calls, item_id % 4 = 0 AS equivalent, CASE item_id % 4 WHEN 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE item_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'parse_error' WHEN 2 THEN '' ELSE 'No candidate answer.' END AS reasoning FROM benchmark""")
def qaf_48(spark, sf):
    i = F.col("id")
    text = F.when(i % 2 == 0, F.concat(F.lit("so <Answer> A"), i.cast("string"), F.lit(" </answer>"))).otherwise(" plain ")
    use = F.lit('{"type":"tool_use"},')
    messages = F.concat(F.lit('[{"content":"x"},{"content":['), F.repeat(use, (i % 3).cast("int")), F.lit('{"type":"text"}]}]'))
    said = F.expr("""CASE id % 4 WHEN 0 THEN '{"is_equivalent":true,"confidence":0.5,"reasoning":" same "}' WHEN 1 THEN '{no' ELSE '{}' END""")
    rows = items(spark, sf).withColumn("m", messages)
    return rows.select("id", op.answer_text(text).alias("answer"), op.tool_uses("m").alias("calls"), op.equivalence(said, F.when(i % 4 == 3, "").otherwise("c")).alias("e")).select("id", "answer", "calls", "e.*")


@query("rub_01_rubric_scores", "SELECT item_id AS id, md5('Rubric: T' || chr(10) || 'D' || chr(10) || 'Question: q' || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'Reference: g' || chr(10) ELSE '' END || 'Response: ' || text || chr(10) || CASE WHEN item_id % 3 = 0 THEN 'Allowed scores: 0.0, 0.5, 1.0' ELSE 'Answer 1 if it holds, else 0.' END) AS prompt, CASE WHEN item_id % 5 = 0 THEN 0.0 WHEN item_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM benchmark")
def rub_01(spark, sf):
    i = F.col("id")
    scores = F.when(i % 3 == 0, F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    said = F.when(i % 5 == 0, "none").otherwise('so {"score": 0.6, "reasoning": "r"}')
    prompt = op.rubric_prompt({"title": F.lit("T"), "description": F.lit("D"), "scores": scores.cast("array<string>")}, F.lit("q"), F.when(i % 2 == 0, " g "), F.col("text"))
    return items(spark, sf).select("id", F.md5(prompt).alias("prompt"), op.rubric_score(said, scores).alias("score"))


@query("rub_05_rubric_cache", "SELECT doc_id AS question_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS rubric FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def rub_05(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"))
    return op.upsert(d.where("question_id % 2 = 0").withColumn("rubric", F.lit("old")), d.where("question_id % 3 = 0").withColumn("rubric", F.lit("new")), ["question_id"])


def rubrics(prompt: str) -> str:
    """A stand-in for a model that makes rubrics."""
    return "noise" if prompt.endswith("3") else f'```json\n{{"positive_rubrics":[{{"title":"P {prompt}","description":"d"}},{{"title":""}}],"negative_rubrics":[{{"title":"N","description":"e"}}]}}\n```'


@query("rub_06_adaptive_rubrics", "SELECT item_id AS question_id, 'positive' AS kind, 'P x' || item_id AS title, 'd' AS description FROM benchmark WHERE item_id % 10 <> 3 UNION ALL SELECT item_id, 'negative', 'N', 'e' FROM benchmark WHERE item_id % 10 <> 3")
def rub_06(spark, sf):
    return op.adaptive_rubrics(items(spark, sf).select(F.col("id").alias("question_id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("prompt")), rubrics)


@query("rwd_08_environment_rows", """SELECT item_id AS id, '[{"role":"system","content":"s"},{"role":"user","content":"q' || item_id || '"}]' AS prompt, CASE WHEN item_id % 2 = 0 THEN 'a' ELSE '' END AS ground_truth, CASE WHEN item_id % 3 = 0 THEN '["r1","r2"]' ELSE '[]' END AS reference_chunks FROM benchmark""")
def rwd_08(spark, sf):
    i = F.col("id")
    rows = items(spark, sf).select("id", F.concat(F.lit("q"), i.cast("string")).alias("question"), F.when(i % 2 == 0, "a").alias("answer"), F.when(i % 3 == 0, F.array(F.lit("r1"), F.lit("r2"))).alias("references"))
    return op.environment_rows(rows, "s")


@query("rwd_09_judge_pairs", "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, value / 100)) END AS correctness, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 0.0 ELSE 1.0 END AS conciseness FROM events")
def rwd_09(spark, sf):
    i = F.col("event_id")
    pair = op.judge_pair(F.when(i % 3 > 0, F.col("value") / 100), F.lit(7.0), F.when(i % 5 == 0, " ").otherwise("r"))
    return table(spark, sf, "events").select("event_id", pair.alias("p")).select("event_id", "p.*")


@query("wik_04_page_prompts", "WITH r AS (SELECT source || lang AS name, doc_id AS id, source AS file, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) SELECT name, md5('Write a page about ' || name || ' from these texts:' || chr(10) || string_agg('[' || k || '] ' || substr(text, 1, 1000), chr(10) ORDER BY k)) AS prompt FROM r WHERE k <= 20 GROUP BY name")
def wik_04(spark, sf):
    d = table(spark, sf, "documents")
    prompts = op.page_prompts(d.select(F.concat("source", "lang").alias("name"), F.col("doc_id").alias("id")), d.select(F.col("doc_id").alias("id"), F.col("source").alias("file"), "text"))
    return prompts.select("name", F.md5("prompt").alias("prompt"))


@query("prf_23_corpus_summaries", """SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN 's' || item_id WHEN 1 THEN 'just text' ELSE '' END AS summary, CASE item_id % 3 WHEN 0 THEN 'a;b' ELSE '' END AS queries FROM benchmark""")
def prf_23(spark, sf):
    said = F.expr("""CASE id % 3 WHEN 0 THEN concat('```json\n{"summary":" s', id, '","queries":["a","b"]}\n```') WHEN 1 THEN 'just text' ELSE '{"queries":3}' END""")
    return items(spark, sf).select("id", op.parse_summary(said).alias("p")).select("id", "p.summary", F.array_join("p.queries", ";").alias("queries"))


@query("llm_02_several_models", "SELECT item_id AS id, model, attempt::INT AS attempt, CASE model WHEN 'long' THEN length(text)::VARCHAR ELSE reverse(text) END AS response FROM benchmark, (SELECT unnest(['long', 'turn']) AS model), (SELECT unnest([1, 2]) AS attempt) WHERE model = 'long' OR length(text) % 2 = 1")
def llm_02(spark, sf):
    from .models import backwards

    return op.ask_models(items(spark, sf).withColumnRenamed("text", "prompt"), {"turn": backwards, "long": lambda p: str(len(p))}, 2)


@query("llm_05_response_parts", """SELECT item_id AS id, CASE item_id % 4 WHEN 0 THEN 'a2' WHEN 1 THEN 'b' WHEN 2 THEN '[REFUSAL]: no' ELSE 'c' END AS answer, CASE item_id % 4 WHEN 0 THEN 't' WHEN 1 THEN 'r' END AS thinking, CASE item_id % 4 WHEN 3 THEN 's' END AS summary, CASE item_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 0 ELSE item_id + 1 END::BIGINT AS tokens FROM benchmark""")
def llm_05(spark, sf):
    payload = F.expr("""CASE id % 4 WHEN 0 THEN '{"content":[{"type":"thinking","thinking":"t"},{"type":"text","text":"a1"},{"type":"text","text":"a2"}],"usage":{"input_tokens":3,"output_tokens":4}}' WHEN 1 THEN '{"choices":[{"message":{"content":"b","reasoning_content":"r"}}],"usage":{"prompt_tokens":2,"completion_tokens":3}}'
 WHEN 2 THEN '{"choices":[{"message":{"content":"","refusal":"no"}}]}' ELSE concat('{"output_text":"c","reasoning":{"summary":"s"},"usage":{"input_tokens":', id, ',"output_tokens":1}}') END""")
    return items(spark, sf).withColumn("p", payload).select("id", op.response_parts("p").alias("r")).select("id", "r.*")
