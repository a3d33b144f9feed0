"""Queries on agent traces, bound to conversations.

Tool messages and calls do not occur in the table; they are made of the turn
number by the same expressions here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sampling import pinned, sample
from ..operators import traces as op
from .registry import query, table


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("trace"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    name = F.expr("CASE trace % 4 WHEN 0 THEN 'get_order' WHEN 1 THEN 'search_docs' WHEN 2 THEN '2bad' ELSE 'find_user' END")
    args = F.concat(F.lit('{"q":"'), F.col("pos").cast("string"), F.lit('","bad-key":"1"}'))
    call = F.when((F.col("role") == "assistant") & (F.col("pos") % 4 == 1), F.array(F.struct(name.alias("name"), args.alias("arguments"))))
    rows = rows.withColumn("calls", F.coalesce(call, F.array().cast("array<struct<name:string,arguments:string>>")))
    short = F.when((F.col("role") == "assistant") & (F.col("trace") % 5 == 0), F.substring("content", 1, 45)).otherwise(F.col("content"))
    tool = (F.col("role") == "user") & (F.col("pos") % 3 == 2)
    return rows.withColumn("content", short).withColumn("role", F.when(tool, "tool").otherwise(F.col("role")))


MESSAGES = "m AS (SELECT conv_id AS trace, turn AS pos, role, text AS content FROM conversations)"
TOOLS = """t AS (SELECT conv_id AS trace, turn AS pos, CASE WHEN role = 'user' AND turn % 3 = 2 THEN 'tool' ELSE role END AS role,
  CASE WHEN role = 'assistant' AND conv_id % 5 = 0 THEN substr(text, 1, 45) ELSE text END AS content,
  CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN CASE conv_id % 4 WHEN 0 THEN 'get_order' WHEN 1 THEN 'search_docs' WHEN 2 THEN '2bad' ELSE 'find_user' END END AS tool FROM conversations)"""


def windows(source: str) -> str:
    return f"""w AS (SELECT *, (first_value(role) OVER (PARTITION BY trace ORDER BY pos) = 'system')::INT AS lead,
  count(*) OVER (PARTITION BY trace ORDER BY pos) - 1 AS n_before,
  sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY trace ORDER BY pos) - 1 AS turn_index,
  sum(CASE WHEN role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY trace ORDER BY pos) AS island FROM {source}),
e AS (SELECT *, n_before - lead AS n_prompt, n_completion FROM (SELECT *, count(*) OVER (PARTITION BY trace, island) AS n_completion FROM w) WHERE role = 'assistant' AND n_before - lead > 0)"""


@query("trc_01_system_prompts", f"WITH {MESSAGES}, f AS (SELECT trace, min_by(content, pos) AS prompt FROM m WHERE role = 'system' GROUP BY trace) SELECT prompt, count(*) AS n, min(trace) AS first_trace, row_number() OVER (ORDER BY count(*) DESC, min(trace))::INT AS rank FROM f GROUP BY prompt")
def trc_01(spark, sf):
    return op.system_prompts(messages(spark, sf))


@query("trc_02_tool_census", f"""WITH {TOOLS}, c AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY trace, pos) AS nth FROM t WHERE tool IS NOT NULL AND regexp_matches(tool, '^[A-Za-z_][A-Za-z0-9_]*$'))
SELECT tool, count(*) AS n_calls, 'q' AS param_keys, string_agg('{{"q":"' || pos || '"}}', '; ' ORDER BY nth) FILTER (WHERE nth <= 3) AS sample_args FROM c GROUP BY tool""")
def trc_02(spark, sf):
    return op.tool_census(tool_messages(spark, sf))


@query("trc_03_window_examples", f"WITH {MESSAGES}, {windows('m')} SELECT trace, pos, turn_index::BIGINT AS turn_index, n_prompt::BIGINT AS n_prompt, n_completion, length(content)::INT AS n_chars FROM e")
def trc_03(spark, sf):
    return op.examples(messages(spark, sf)).select("trace", "pos", "turn_index", "n_prompt", "n_completion", F.length("content").alias("n_chars"))


@query("trc_04_rendering", f"""WITH {TOOLS}, {windows('t')}, l AS (SELECT *, '[' || upper(role) || '] ' || content AS line FROM w)
SELECT e.trace, e.turn_index::BIGINT AS turn_index, md5((SELECT string_agg(line, chr(10) ORDER BY l.pos) FROM l WHERE l.trace = e.trace AND l.pos < e.pos AND NOT (l.n_before = 0 AND l.role = 'system'))) AS prompt,
md5((SELECT string_agg(line, chr(10) ORDER BY l.pos) FROM l WHERE l.trace = e.trace AND l.island = e.island)) AS ground_truth FROM e""")
def trc_04(spark, sf):
    rows = op.examples(tool_messages(spark, sf), with_text=True)
    return rows.select("trace", "turn_index", F.md5("prompt").alias("prompt"), F.md5("ground_truth").alias("ground_truth"))


@query("trc_05_min_length", f"WITH {TOOLS}, {windows('t')} SELECT trace, turn_index::BIGINT AS turn_index, CASE WHEN length(content) < 50 THEN 'heuristic:too_short' END AS reason FROM e")
def trc_05(spark, sf):
    rows = op.examples(tool_messages(spark, sf))
    return rows.select("trace", "turn_index", op.drop_reason(F.col("content"), F.col("calls"), min_chars=50).alias("reason"))


EXCLUDED = ("get_order", "search_docs")


@query("trc_06_excluded_tools", f"WITH {TOOLS}, {windows('t')} SELECT trace, turn_index::BIGINT AS turn_index, CASE WHEN tool IN {EXCLUDED} AND length(content) < 50 THEN 'tool_calls:excluded:' || tool END AS reason FROM e")
def trc_06(spark, sf):
    rows = op.examples(tool_messages(spark, sf))
    return rows.select("trace", "turn_index", op.drop_reason(F.col("content"), F.col("calls"), min_chars=0, exclude=EXCLUDED).alias("reason"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(content), '[ \\t\\r\\n\\x0b\\x0c]+'), lambda x: length(x) > 1))"


RELAY = f"""k AS (SELECT trace, pos, role, {WORDS} AS words FROM t),
o AS (SELECT a.trace, a.pos, max(len(list_intersect(a.words, b.words)) / len(a.words)) AS overlap FROM k a JOIN k b ON a.trace = b.trace AND b.pos < a.pos AND b.role = 'tool' AND len(b.words) > 0 WHERE a.role = 'assistant' AND len(a.words) > 0 GROUP BY ALL)"""


@query("trc_07_tool_relay", f"WITH {TOOLS}, {RELAY} SELECT t.trace, t.pos, round(overlap, 6) AS overlap FROM t LEFT JOIN o ON t.trace = o.trace AND t.pos = o.pos WHERE role = 'assistant'")
def trc_07(spark, sf):
    return op.relay_overlap(tool_messages(spark, sf)).select("trace", "pos", F.round("overlap", 6).alias("overlap"))


GRAMS = r"""g AS (SELECT doc_id AS id, list_distinct(list_transform(generate_series(1, length(x) - 2), lambda i: substr(x, i::BIGINT, 3))) AS grams FROM (SELECT doc_id,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(substr(text, 1, 500)), '[^ \t\r\n\x0b\x0c]+@[^ \t\r\n\x0b\x0c]+', '<EMAIL>', 'g'), '\b[0-9]+\b', '<N>', 'g'), '[ \t\r\n\x0b\x0c]+', ' ', 'g')) AS x FROM documents) WHERE length(x) > 2)"""


@query("trc_08_near_duplicate_completions", f"""WITH {GRAMS}, c AS (SELECT min(id) AS id, grams FROM (SELECT id, list_sort(grams) AS grams FROM g) GROUP BY grams)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))), 6) AS similarity
FROM c a JOIN c b ON a.id < b.id AND least(len(a.grams), len(b.grams)) > 0.85 * greatest(len(a.grams), len(b.grams))
WHERE len(list_intersect(a.grams, b.grams)) > 0.85 * (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams)))""")
def trc_08(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return op.near_duplicate_pairs(rows).withColumn("similarity", F.round("similarity", 6))


CHAIN = f"""r AS (SELECT e.trace, turn_index, CASE WHEN length(content) < 40 THEN 'heuristic:too_short' WHEN tool IN {EXCLUDED} AND length(content) < 50 THEN 'tool_calls:excluded:' || tool
  WHEN tool IS NULL AND overlap > 0.3 THEN 'tool_relay:relay' END AS reason FROM e LEFT JOIN o ON e.trace = o.trace AND e.pos = o.pos)"""


def chain(spark, sf) -> DataFrame:
    rows = tool_messages(spark, sf)
    relay = op.relay_overlap(rows).select("trace", "pos", "overlap")
    kept = op.examples(rows).join(relay, ["trace", "pos"], "left")
    return kept.withColumn("reason", op.drop_reason(F.col("content"), F.col("calls"), F.col("overlap"), exclude=EXCLUDED, overlap=0.3))


@query("trc_09_filter_chain", f"WITH {TOOLS}, {windows('t')}, {RELAY}, {CHAIN} SELECT trace, turn_index::BIGINT AS turn_index, reason FROM r")
def trc_09(spark, sf):
    return chain(spark, sf).select("trace", "turn_index", "reason")


@query("trc_10_drop_summary", f"WITH {TOOLS}, {windows('t')}, {RELAY}, {CHAIN} SELECT split_part(reason, ':', 1) AS filter, split_part(reason, ':', 2) AS reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ROLLUP (1, 2)")
def trc_10(spark, sf):
    rows = chain(spark, sf).where("reason is not null").select(F.split_part("reason", F.lit(":"), F.lit(1)).alias("filter"), F.split_part("reason", F.lit(":"), F.lit(2)).alias("reason"))
    return rows.rollup("filter", "reason").agg(F.count("*").alias("n"))


SCORED = "s AS (SELECT m.trace, m.pos, quality::DOUBLE AS score FROM m LEFT JOIN labels ON m.trace = labels.doc_id WHERE role = 'assistant')"


def scored(spark, sf) -> DataFrame:
    rows = messages(spark, sf).where("role = 'assistant'")
    return rows.join(table(spark, sf, "labels").select(F.col("doc_id").alias("trace"), F.col("quality").cast("double").alias("score")), "trace", "left")


@query("trc_11_outcome_balance", f"""WITH {MESSAGES}, {SCORED}, c AS (SELECT count(*) AS total, count(*) FILTER (score >= 0.5) AS successes, count(*) FILTER (score < 0.5) AS failures, count(*) FILTER (score IS NULL) AS unknown FROM s)
SELECT *, CASE WHEN successes + failures > 0 THEN failures / (successes + failures) ELSE 0.0 END AS failure_fraction, successes + failures = 0 OR failures / (successes + failures) >= 0.15 AS is_balanced FROM c""")
def trc_11(spark, sf):
    return op.outcome_balance(scored(spark, sf))


@query("trc_12_score_range", f"WITH {MESSAGES}, {SCORED} SELECT * FROM s WHERE score >= 0.5 AND score <= 1.0")
def trc_12(spark, sf):
    return op.score_range(scored(spark, sf), "score", 0.5, 1.0).select("trace", "pos", "score")


PINNED = "md5('42|' || trace || '|' || turn_index)"


@query("trc_13_capped_sample", f"WITH {MESSAGES}, {windows('m')} SELECT trace, turn_index::BIGINT AS turn_index FROM e ORDER BY {PINNED}, trace, turn_index LIMIT 50")
def trc_13(spark, sf):
    return sample(op.examples(messages(spark, sf)), 50, 42, "trace", "turn_index").select("trace", "turn_index")


@query("trc_14_split", f"WITH {MESSAGES}, {windows('m')}, r AS (SELECT trace, turn_index::BIGINT AS turn_index, row_number() OVER (ORDER BY {PINNED}, trace, turn_index)::INT AS place FROM e) SELECT *, CASE WHEN place <= 40 THEN 'train' ELSE 'eval' END AS part FROM r WHERE place <= 50")
def trc_14(spark, sf):
    return op.split(op.examples(messages(spark, sf)), 40, 10, ["trace", "turn_index"]).select("trace", "turn_index", "place", "part")


@query("trc_15_jsonl", f"""WITH {MESSAGES}, {windows('m')} SELECT trace, turn_index::BIGINT AS turn_index, md5('{{"trace_id":' || trace || ',"turn_index":' || turn_index || ',"total_messages":' || (n_prompt + n_completion) || '}}') AS line FROM e""")
def trc_15(spark, sf):
    rows = op.examples(messages(spark, sf))
    args = F.to_json(F.struct(F.col("trace").alias("trace_id"), "turn_index", (F.col("n_prompt") + F.col("n_completion")).alias("total_messages")))
    return rows.select("trace", "turn_index", F.md5(args).alias("line"))


SPANS = "x AS (SELECT conv_id || '-' || turn AS span_id, CASE WHEN conv_id % 3 = 0 THEN conv_id || '-none' ELSE conv_id || '-1' END AS root_span_id, turn AS arrival FROM conversations)"


@query("trc_16_span_groups", f"""WITH {SPANS}, r AS (SELECT root_span_id, coalesce(min(span_id) FILTER (span_id = root_span_id), min_by(span_id, arrival)) AS root FROM x GROUP BY root_span_id)
SELECT r.root_span_id, any_value(root) AS root, coalesce(string_agg(span_id, ',' ORDER BY arrival) FILTER (span_id <> root), '') AS children FROM x JOIN r ON x.root_span_id = r.root_span_id GROUP BY r.root_span_id""")
def trc_16(spark, sf):
    rows = table(spark, sf, "conversations")
    key = lambda x: F.concat_ws("-", F.col("conv_id"), x)
    root = F.when(F.col("conv_id") % 3 == 0, key(F.lit("none"))).otherwise(key(F.lit("1")))
    return op.group_spans(rows.select(key(F.col("turn")).alias("span_id"), root.alias("root_span_id"), F.col("turn").alias("arrival")))


@query("trc_20_trivial_turns", rf"""WITH {TOOLS}, {windows('t')}, x AS (SELECT trace, turn_index, tool, CASE trace % 3 WHEN 0 THEN 'Hello, ' || content WHEN 1 THEN 'Please share your email. ' || substr(content, 1, 60) ELSE substr(content, 1, 40) END AS content FROM e)
SELECT trace, turn_index::BIGINT AS turn_index, (turn_index = 0 AND tool IS NULL AND regexp_matches(content, '(?i)^(hi|hello|hey|good\s+(morning|afternoon|evening)|welcome|greetings)\b'))
  OR (tool IS NULL AND length(content) < 200 AND regexp_matches(content, '(?i)\b(provide|share|give|tell)\b.*\b(name|email|order\s*(id|number)|zip|account)\b'))
  OR (tool IS NOT NULL AND length(content) < 50 AND regexp_matches(tool, '^(get_|find_|lookup_|fetch_)')) AS trivial FROM x""")
def trc_20(spark, sf):
    rows = op.examples(tool_messages(spark, sf))
    text = F.expr("CASE trace % 3 WHEN 0 THEN concat('Hello, ', content) WHEN 1 THEN concat('Please share your email. ', substr(content, 1, 60)) ELSE substr(content, 1, 40) END")
    return rows.withColumn("content", text).select("trace", "turn_index", op.is_trivial(F.col("content"), F.col("calls"), F.col("turn_index")).alias("trivial"))


@query("trc_21_judge_context", f"""WITH {MESSAGES}, w AS (SELECT trace, string_agg('[' || upper(role) || '] ' || substr(content, 1, 300), chr(10) ORDER BY pos) AS x, max_by(substr(content, 1, 150), pos) FILTER (role = 'assistant' AND content <> '') AS f FROM m GROUP BY trace)
SELECT trace, md5(CASE WHEN length(x) > 1500 THEN substr(x, 1, 1500) || chr(10) || '... (truncated)' ELSE x END) AS context, 'Final response: ' || f AS outcome FROM w""")
def trc_21(spark, sf):
    return op.trace_context(messages(spark, sf), chars=1500).withColumn("context", F.md5("context"))


RATED = "q AS (SELECT trace, turn_index::BIGINT AS turn_index, CASE WHEN (trace * 7 + turn_index * 3) % 11 < 9 THEN ((trace * 7 + turn_index * 3) % 11) / 10.0 END AS rating FROM e)"


def rated(spark, sf) -> DataFrame:
    code = (F.col("trace") * 7 + F.col("turn_index") * 3) % 11
    return op.examples(messages(spark, sf)).select("trace", "turn_index", F.when(code < 9, code / 10.0).alias("rating"))


@query("trc_23_pivot_selection", f"""WITH {MESSAGES}, {windows('m')}, {RATED}, b AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || trace || '|' || turn_index), trace, turn_index) AS k, count(*) OVER () AS n FROM q WHERE coalesce(rating, 0) < 0.6)
SELECT trace, turn_index, 'pivot' AS kind FROM q WHERE rating >= 0.6 UNION ALL SELECT trace, turn_index, 'anchor' FROM b WHERE k <= greatest(1, floor(n * 0.1))""")
def trc_23(spark, sf):
    return op.select_pivots(rated(spark, sf), "rating", ["trace", "turn_index"]).select("trace", "turn_index", "kind")


@query("trc_24_unrated", f"WITH {MESSAGES}, {windows('m')}, {RATED} SELECT trace, turn_index FROM q WHERE rating IS NULL")
def trc_24(spark, sf):
    rows = rated(spark, sf)
    return op.unrated(rows, rows.where("rating is not null"), ["trace", "turn_index"]).select("trace", "turn_index")


@query("trc_25_pivot_summary", f"WITH {MESSAGES}, {windows('m')}, {RATED} SELECT CASE WHEN rating >= 0.6 THEN 'pivot' WHEN rating >= 0.3 THEN 'downstream' WHEN rating IS NULL THEN 'unrated' ELSE 'trivial' END AS category, count(*) AS n, round(avg(rating), 6) AS mean_rating FROM q GROUP BY 1")
def trc_25(spark, sf):
    return op.pivot_summary(rated(spark, sf))


@query("trc_13b_pinned_order", "SELECT conv_id, turn, md5('7|' || conv_id || '|' || turn) AS pin FROM conversations")
def trc_13b(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", pinned(7, F.col("conv_id"), F.col("turn")).alias("pin"))
