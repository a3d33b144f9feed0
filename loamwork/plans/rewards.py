"""Queries on rewards, rubrics and costs; completions are assistant turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rewards as op
from .registry import query, table

BASE = """c AS (SELECT conv_id, turn, text, (turn % 4)::INT AS n_refs, ((conv_id + turn) % 11) / 10 AS correct,
 CASE conv_id % 3 WHEN 0 THEN substr(text, 1, 80) || ' [Source: s' || turn || '] [source:  s2 ]<Answer> ' || substr(text, 1, 20) || '</answer>' WHEN 1 THEN repeat('<tool_call>x', (conv_id % 13)::INT) || substr(text, 1, 50) ELSE text END AS completion
 FROM conversations WHERE role = 'assistant')"""


def completions(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'assistant'")
    text = F.expr("CASE conv_id % 3 WHEN 0 THEN concat(substr(text, 1, 80), ' [Source: s', turn, '] [source:  s2 ]<Answer> ', substr(text, 1, 20), '</answer>') WHEN 1 THEN concat(repeat('<tool_call>x', cast(conv_id % 13 as int)), substr(text, 1, 50)) ELSE text END")
    return rows.select("conv_id", "turn", "text", (F.col("turn") % 4).cast("int").alias("n_refs"), ((F.col("conv_id") + F.col("turn")) % 11 / 10).alias("correct"), text.alias("completion"))


REFS = "list_transform(generate_series(1, n_refs), lambda i: 's' || i)"
CITED = r"list_distinct(list_filter(list_transform(regexp_extract_all(completion, '(?i)\[source:[ \t\r\n]*([^\]]+)\]', 1), lambda c: trim(c)), lambda c: c <> ''))"


def refs():
    return F.when(F.col("n_refs") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_refs"), F.lit(1))), lambda i: F.concat(F.lit("s"), i.cast("string")))).otherwise(F.array().cast("array<string>"))


@query("rwd_01_character_overlap")
def rwd_01(spark, sf):
    rows = completions(spark, sf)
    return rows.select("conv_id", "turn", F.round(op.character_overlap(F.col("text"), F.col("completion")), 6).alias("share"))


@query("rwd_02_overlap_reward", f"WITH {BASE} SELECT conv_id, turn, CASE WHEN (length(completion) - length(replace(completion, '<tool_call>', ''))) / 11 >= 4 OR correct < 0.25 THEN 0.0 ELSE correct END AS reward FROM c")
def rwd_02(spark, sf):
    return completions(spark, sf).select("conv_id", "turn", op.overlap_reward(F.col("correct"), op.call_count(F.col("completion"))).alias("reward"))


@query("rwd_03_answer_block", f"WITH {BASE} SELECT conv_id, turn, md5(trim(CASE WHEN regexp_matches(completion, '(?is)<answer>.*?</answer>') THEN regexp_extract(completion, '(?is)<answer>(.*?)</answer>', 1) ELSE completion END)) AS answer FROM c")
def rwd_03(spark, sf):
    return completions(spark, sf).select("conv_id", "turn", F.md5(op.answer_block(F.col("completion"))).alias("answer"))


@query("rwd_04_call_count", f"WITH {BASE} SELECT conv_id, turn, ((length(completion) - length(replace(completion, '<tool_call>', ''))) // 11)::INT AS calls, (length(completion) - length(replace(completion, '<tool_call>', ''))) // 11 <= 10 AS within_budget FROM c")
def rwd_04(spark, sf):
    calls = op.call_count(F.col("completion"))
    return completions(spark, sf).select("conv_id", "turn", calls.alias("calls"), (calls <= 10).alias("within_budget"))


SCORES = f"""s AS (SELECT *, {CITED} AS cited, {REFS} AS refs FROM c), p AS (SELECT *, CASE WHEN len(cited) = 0 THEN 0.0 WHEN len(refs) = 0 THEN 1.0 ELSE len(list_intersect(cited, refs)) / len(cited) END AS precision,
CASE WHEN len(cited) = 0 OR len(refs) = 0 THEN 0.0 ELSE len(list_intersect(cited, refs)) / len(refs) END AS recall, (length(completion) - length(replace(completion, '<tool_call>', ''))) // 11 AS calls FROM s),
e AS (SELECT *, CASE WHEN correct <= 0 OR calls > 10 THEN 0.0 ELSE correct * exp(-0.2 * greatest(0, calls - (n_refs + 2))) END AS eff FROM p)"""


def scored(spark, sf):
    rows = completions(spark, sf)
    precision, recall = op.citation_scores(op.citations(F.col("completion")), refs())
    calls = op.call_count(F.col("completion"))
    return rows.withColumn("precision", precision).withColumn("recall", recall).withColumn("calls", calls).withColumn("eff", op.efficiency(F.col("correct"), calls, F.col("n_refs")))


@query("rwd_05_citations", f"WITH {BASE}, {SCORES} SELECT conv_id, turn, round(precision::DOUBLE, 6) AS precision, round(recall::DOUBLE, 6) AS recall FROM e")
def rwd_05(spark, sf):
    return scored(spark, sf).select("conv_id", "turn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("rwd_06_efficiency", f"WITH {BASE}, {SCORES} SELECT conv_id, turn, round(eff::DOUBLE, 6) AS efficiency FROM e")
def rwd_06(spark, sf):
    return scored(spark, sf).select("conv_id", "turn", F.round("eff", 6).alias("efficiency"))


@query("rwd_07_reward", f"WITH {BASE}, {SCORES} SELECT conv_id, turn, round((correct + CASE WHEN n_refs > 0 THEN 0.5 * precision + 0.5 * recall ELSE 0 END + 0.5 * eff + 0.1 * CASE WHEN correct > 0 THEN 1 - correct ELSE 0 END)::DOUBLE, 6) AS reward FROM e")
def rwd_07(spark, sf):
    precision, recall = op.env_citation_scores(op.citations(F.col("completion")), refs())
    total = op.reward(F.col("correct"), precision, recall, F.col("eff"), 1 - F.col("correct"))
    return scored(spark, sf).select("conv_id", "turn", F.round(total, 6).alias("reward"))


@query("rwd_10_truncation", "SELECT conv_id, turn, md5(CASE WHEN length(text) > 300 THEN rtrim(substr(text, 1, 285)) || '... (truncated)' ELSE text END) AS text FROM conversations")
def rwd_10(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(op.truncated(F.col("text"), 300, "... (truncated)")).alias("text"))


RUBRICS = "r AS (SELECT event_id // 7 AS response, event_type || (user_id % 3) AS rubric, CASE WHEN user_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity, CASE WHEN event_type = 'error' THEN 1.0 ELSE (event_id % 11) / 10 END AS score FROM events)"


def rubrics(spark, sf):
    e = table(spark, sf, "events")
    score = F.when(F.col("event_type") == "error", 1.0).otherwise(F.col("event_id") % 11 / 10)
    return e.select(F.floor(F.col("event_id") / 7).alias("response"), F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("rubric"), F.when(F.col("user_id") % 2 == 0, "positive").otherwise("negative").alias("polarity"), score.alias("score"))


@query("rub_02_retained_rubrics", f"WITH {RUBRICS}, s AS (SELECT rubric, polarity, round(stddev_pop(score), 6) AS spread FROM r GROUP BY ALL HAVING round(stddev_pop(score), 6) > 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY polarity ORDER BY spread DESC, rubric)::INT AS rank FROM s) WHERE rank <= 3")
def rub_02(spark, sf):
    return op.retained_rubrics(rubrics(spark, sf))


@query("rub_03_adaptive_reward", f"WITH {RUBRICS} SELECT response, round(greatest(0.0, least(1.0, (sum(CASE WHEN polarity = 'positive' THEN score ELSE -score END) + count(*) FILTER (polarity <> 'positive')) / count(*)))::DOUBLE, 6) AS reward FROM r GROUP BY response")
def rub_03(spark, sf):
    return op.adaptive_reward(rubrics(spark, sf))


@query("rub_04_static_reward", f"WITH {RUBRICS} SELECT trim(regexp_replace(lower(rubric || ' (' || polarity || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS key, round(sum(CASE WHEN polarity = 'positive' THEN score ELSE 1 - score END)::DOUBLE, 6) AS reward FROM r GROUP BY 1")
def rub_04(spark, sf):
    key = op.slug(F.concat("rubric", F.lit(" ("), "polarity", F.lit(")")))
    return rubrics(spark, sf).groupBy(key.alias("key")).agg(F.round(F.sum(op.static_reward(F.col("polarity"), F.col("score"))), 6).alias("reward"))


@query("llm_03_model_costs", """WITH u AS (SELECT 'm' || (user_id % 4) AS model, event_id % 900 AS n_in, event_id % 300 AS n_out, value AS latency FROM events), p(model, price_in, price_out) AS (VALUES ('m0', 0.5, 1.5), ('m1', 0.1, 0.4), ('m2', 2.0, 8.0))
SELECT u.model, count(*) AS calls, sum(n_in + n_out)::BIGINT AS tokens, round(avg(latency), 6) AS mean_latency, round(sum(n_in / 1000 * price_in + n_out / 1000 * price_out)::DOUBLE, 6) AS cost FROM u LEFT JOIN p ON u.model = p.model GROUP BY u.model""")
def llm_03(spark, sf):
    usage = table(spark, sf, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), (F.col("event_id") % 900).alias("n_in"), (F.col("event_id") % 300).alias("n_out"), F.col("value").alias("latency"))
    prices = spark.createDataFrame([("m0", 0.5, 1.5), ("m1", 0.1, 0.4), ("m2", 2.0, 8.0)], "model string, price_in double, price_out double")
    return op.model_costs(usage, prices)
