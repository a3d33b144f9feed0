"""Queries on question-answer rows, made of documents by the same expressions here and in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import qa as op
from ..operators.search import bm25
from .registry import query, table
from .search import BM25, corpus, items

BASE = r"""qa AS (SELECT doc_id AS id, lang,
 CASE doc_id % 8 WHEN 0 THEN 'How do I use ' || substr(text, 1, 30) || '?' WHEN 1 THEN 'troubleshoot error ' || substr(text, 1, 20) WHEN 2 THEN lower(substr(text, 1, 25)) WHEN 3 THEN 'Where can I find the table of contents and more' WHEN 4 THEN 'Cannot create a question' WHEN 5 THEN 'short' WHEN 6 THEN 'widget and ' || substr(text, 1, 15) ELSE substr(text, 1, 80) END AS question,
 CASE doc_id % 5 WHEN 0 THEN substr(text, 1, 200) WHEN 1 THEN 'Insufficient data' WHEN 2 THEN 'Check out the docs. ' || substr(text, 1, 60) WHEN 3 THEN 'Go to Settings > ' || substr(text, 1, 90) ELSE substr(text, 5, 40) END AS answer,
 CASE WHEN doc_id % 3 = 0 THEN 'multi_hop' ELSE 'lookup' END AS qa_type, (doc_id % 4)::INT AS n_refs, (doc_id % 3)::INT AS refinements, ((doc_id * 7) % 11)::INT AS j, CASE WHEN doc_id % 9 = 0 THEN 'odd' ELSE 'natural' END AS style FROM documents)"""


def rows(spark, sf):
    q = F.expr("CASE doc_id % 8 WHEN 0 THEN concat('How do I use ', substr(text, 1, 30), '?') WHEN 1 THEN concat('troubleshoot error ', substr(text, 1, 20)) WHEN 2 THEN lower(translate(substr(text, 1, 25), '\u03a3\u0130', '\u03c3i')) WHEN 3 THEN 'Where can I find the table of contents and more' WHEN 4 THEN 'Cannot create a question' WHEN 5 THEN 'short' WHEN 6 THEN concat('widget and ', substr(text, 1, 15)) ELSE substr(text, 1, 80) END")
    a = F.expr("CASE doc_id % 5 WHEN 0 THEN substr(text, 1, 200) WHEN 1 THEN 'Insufficient data' WHEN 2 THEN concat('Check out the docs. ', substr(text, 1, 60)) WHEN 3 THEN concat('Go to Settings > ', substr(text, 1, 90)) ELSE substr(text, 5, 40) END")
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        i.alias("id"), "lang", q.alias("question"), a.alias("answer"), F.when(i % 3 == 0, "multi_hop").otherwise("lookup").alias("qa_type"), (i % 4).cast("int").alias("n_refs"),
        (i % 3).cast("int").alias("refinements"), ((i * 7) % 11).cast("int").alias("j"), F.when(i % 9 == 0, "odd").otherwise("natural").alias("style"),
    )


def many(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(?i)" + p.replace("'", "''") + "')" for p in patterns) + ")"


META = f"({many('question', op.META_QUESTION)} OR {many('answer', op.META_ANSWER)})"


@query("qaf_01_apportionment", "WITH w AS (SELECT source AS key, sum(n_chars)::DOUBLE AS weight FROM documents GROUP BY source), q AS (SELECT key, weight, 137 * weight / sum(weight) OVER () AS quota FROM w), r AS (SELECT key, floor(quota) AS base, row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, weight DESC, key DESC) AS place, sum(floor(quota)) OVER () AS given FROM q) SELECT key, (base + CASE WHEN place <= 137 - given THEN 1 ELSE 0 END)::BIGINT AS n FROM r")
def qaf_01(spark, sf):
    weights = table(spark, sf, "documents").groupBy(F.col("source").alias("key")).agg(F.sum("n_chars").cast("double").alias("weight"))
    return op.apportioned(weights, 137)


@query("qaf_08_guards", f"""WITH {BASE} SELECT id, CASE WHEN length(trim(question)) < 12 THEN 'question_too_short' WHEN style NOT IN ('keyword', 'natural', 'expert') THEN 'invalid_style' WHEN length(trim(answer)) < 50 THEN 'answer_too_short'
WHEN n_refs < 1 THEN 'no_references' WHEN {META} THEN 'meta_question' WHEN j / 10.0 >= 0.75 THEN 'redundant_chunks' END AS reason FROM qa""")
def qaf_08(spark, sf):
    return rows(spark, sf).select("id", op.guard_reason(F.col("question"), F.col("answer"), F.col("n_refs"), F.col("style"), F.col("j") / 10.0).alias("reason"))


@query("qaf_09_language_share", r"""WITH t AS (SELECT item_id, replace(CASE WHEN item_id % 2 = 0 THEN '한국어 질문 ' || substr(text, 1, 5) ELSE text END, ' ', '') AS x FROM benchmark)
SELECT item_id, round(len(regexp_extract_all(x, '[\x{AC00}-\x{D7A3}\x{3131}-\x{318E}]')) / length(x), 6) AS share FROM t""")
def qaf_09(spark, sf):
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("한국어 질문 "), F.substring("text", 1, 5))).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.round(op.language_share(text, "korean"), 6).alias("share"))


@query("qaf_10_pair_overlap", """WITH s AS (SELECT doc_id // 3 AS qid, doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
p AS (SELECT a.qid, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS s FROM s a JOIN s b ON a.qid = b.qid AND a.doc_id < b.doc_id)
SELECT q.qid, round(coalesce(max(p.s), 0.0), 6) AS overlap FROM (SELECT DISTINCT qid FROM s) q LEFT JOIN p ON q.qid = p.qid GROUP BY q.qid""")
def qaf_10(spark, sf):
    refs = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 3).alias("qid")).agg(F.collect_list("text").alias("contents"))
    return refs.select("qid", F.round(op.max_pair_overlap(F.col("contents")), 6).alias("overlap"))


def one(names: list[str]) -> str:
    return r"(?i)\b(" + "|".join(names) + r")\b"


NW = r"len(list_filter(regexp_split_to_array({}, '[ \t\r\n\x0b\x0c]+'), lambda x: x <> ''))"
NS = "len(regexp_split_to_array(trim({}), '[.!?]+'))"
GATE = f"""g AS (SELECT *, regexp_matches(question, '{one(op.CONNECTORS)}') AS con, regexp_matches(question, '(?i){op.SCENARIO}') AS sce, {NW.format('question')} AS qw, {NW.format('answer')} AS aw FROM qa)"""


@query("qaf_11_quality_gate", f"""WITH {BASE}, {GATE} SELECT id, CASE WHEN (NOT regexp_matches(question, '{one(op.VERBS)}'))::INT + (NOT regexp_matches(question, '(?i)^({'|'.join(op.INTERROGATIVES)})\\b') AND NOT sce AND con)::INT + (qw <= 8 AND NOT contains(question, '?') AND NOT sce AND con)::INT >= 2 THEN 'fragment'
WHEN {many('question', op.STRUCTURAL)} THEN 'structural' WHEN CASE WHEN {many('question', op.GUIDE_QUESTION)} THEN NOT regexp_matches(answer, '(?i){op.NAVIGATION}') ELSE {many('answer', op.GUIDE_ANSWER)} END THEN 'guide_pointer'
WHEN (aw < 15 AND aw < qw * 0.5) OR ({NS.format('question')} > 1 AND {NS.format('answer')} <= 1 AND aw < 20) THEN 'thin_answer' END AS reason FROM g""")
def qaf_11(spark, sf):
    return rows(spark, sf).select("id", op.gate_reason(F.col("question"), F.col("answer")).alias("reason"))


@query("qaf_12_retrieval_verdict", f"WITH {BASE} SELECT id, CASE WHEN j / 10.0 >= 0.65 THEN 'too_easy' WHEN id % 2 = 0 AND (id % 10) / 10.0 >= 0.85 AND j > 0 THEN 'too_easy' ELSE 'passed' END AS verdict FROM qa")
def qaf_12(spark, sf):
    return rows(spark, sf).select("id", op.retrieval_verdict(F.col("j") / 10.0, F.col("id") % 2 == 0, (F.col("id") % 10) / 10.0).alias("verdict"))


@query("qaf_12b_measured_overlap", f"WITH {BM25}, r AS (SELECT item_id AS qid, unnest([item_id, item_id + 40, item_id + 80]) AS id FROM benchmark UNION SELECT qid, id FROM bm WHERE rank = 2 OR (rank = 3 AND qid % 2 = 0)), o AS (SELECT r.qid, count(bm.id) / count(*) AS overlap FROM r LEFT JOIN bm ON bm.qid = r.qid AND bm.id = r.id AND rank <= 5 GROUP BY r.qid) SELECT qid, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.4 THEN 'too_easy' ELSE 'passed' END AS verdict FROM o")
def qaf_12b(spark, sf):
    hits = bm25(corpus(spark, sf), items(spark, sf))
    made = items(spark, sf).select("qid", F.explode(F.array("qid", F.col("qid") + 40, F.col("qid") + 80)).alias("id"))
    refs = made.union(hits.where("rank = 2 OR (rank = 3 AND qid % 2 = 0)").select("qid", "id"))
    found = op.reference_overlap(refs, hits)
    return found.select("qid", F.round("overlap", 6).alias("overlap"), op.retrieval_verdict(F.col("overlap"), F.lit(False), F.lit(0.0), limit=0.4).alias("verdict"))


@query("qaf_14_grounding_verdict", f"WITH {BASE} SELECT id, CASE WHEN j > 3 THEN 'passed' WHEN refinements < 2 THEN 'needs_refinement' ELSE 'rejected' END AS verdict FROM qa")
def qaf_14(spark, sf):
    return rows(spark, sf).select("id", op.grounding_verdict(F.col("j") > 3, F.col("refinements")).alias("verdict"))


@query("qaf_17_hop_verdict", f"WITH {BASE} SELECT id, CASE WHEN j % 3 = 0 AND j % 2 = 0 THEN 'valid' WHEN j % 3 = 0 AND refinements < 2 THEN 'needs_refinement' WHEN j % 3 = 0 THEN 'rejected' WHEN n_refs - j % 3 >= 2 THEN 'demoted' WHEN refinements < 2 THEN 'needs_refinement' ELSE 'rejected' END AS verdict FROM qa")
def qaf_17(spark, sf):
    return rows(spark, sf).select("id", op.hop_verdict(F.col("n_refs"), F.col("j") % 3, F.col("refinements"), n_low=F.col("j") % 2).alias("verdict"))


@query("qaf_18_difficulty", f"WITH {BASE} SELECT id, round((0.4 * least(n_refs / 4, 1.0) + 0.6 * (j / 10))::DOUBLE, 4) AS difficulty FROM qa")
def qaf_18(spark, sf):
    return rows(spark, sf).select("id", op.difficulty(F.col("n_refs"), F.col("j") / 10).alias("difficulty"))


COMP = "CASE WHEN (CASE WHEN id % 5 > 0 THEN 0.4 ELSE 0 END + CASE WHEN id % 4 > 0 THEN 0.3 ELSE 0 END + CASE WHEN id % 3 > 0 THEN 0.3 ELSE 0 END) > 0 THEN round(((CASE WHEN id % 5 > 0 THEN 0.4 * j / 10 ELSE 0 END + CASE WHEN id % 4 > 0 THEN 0.3 * (1 - j / 10) ELSE 0 END + CASE WHEN id % 3 > 0 THEN 0.3 * 0.75 ELSE 0 END) / (CASE WHEN id % 5 > 0 THEN 0.4 ELSE 0 END + CASE WHEN id % 4 > 0 THEN 0.3 ELSE 0 END + CASE WHEN id % 3 > 0 THEN 0.3 ELSE 0 END))::DOUBLE, 6) END"


def composites(spark, sf):
    i, j = F.col("id"), F.col("j")
    score = op.composite(F.when(i % 5 > 0, j / 10), F.when(i % 4 > 0, 1 - j / 10), F.when(i % 3 > 0, F.lit(0.75)))
    return rows(spark, sf).withColumn("score", F.round(score, 6))


@query("qaf_21_composite", f"WITH {BASE} SELECT id, {COMP} AS score FROM qa")
def qaf_21(spark, sf):
    return composites(spark, sf).select("id", "score")


BIGRAMS = r"""bg AS (SELECT id, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i::BIGINT] || ' ' || w[i::BIGINT + 1])) AS b FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents) WHERE len(w) > 1)"""


@query("qaf_24_early_dedup", f"WITH {BIGRAMS} SELECT a.id, round(max(len(list_intersect(a.b, c.b)) / (len(a.b) + len(c.b) - len(list_intersect(a.b, c.b)))), 6) AS similarity FROM bg a JOIN bg c ON a.id % 2 = 1 AND c.id % 2 = 0 AND len(list_intersect(a.b, c.b)) >= 0.7 * (len(a.b) + len(c.b) - len(list_intersect(a.b, c.b))) GROUP BY a.id")
def qaf_24(spark, sf):
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    return op.near_questions(q.where("id % 2 = 1"), q.where("id % 2 = 0")).withColumn("similarity", F.round("similarity", 6))


TYPE = "CASE WHEN qa_type = 'lookup' AND n_refs >= 2 THEN 'multi_hop' WHEN qa_type = 'multi_hop' AND n_refs <= 1 THEN 'lookup' ELSE qa_type END"


@query("qaf_26_effective_type", f"WITH {BASE} SELECT id, {TYPE} AS type FROM qa")
def qaf_26(spark, sf):
    return rows(spark, sf).select("id", op.effective_type(F.col("qa_type"), F.col("n_refs")).alias("type"))


ACCEPT = f"ac AS (SELECT id, type, n_refs, place, place <= CASE type WHEN 'lookup' THEN 30 ELSE 70 END AS accepted FROM (SELECT id, n_refs, {TYPE} AS type, row_number() OVER (PARTITION BY {TYPE} ORDER BY coalesce({COMP}, -1) DESC, id)::INT AS place FROM qa))"


def accepted(spark, sf):
    r = composites(spark, sf).select("id", "n_refs", op.effective_type(F.col("qa_type"), F.col("n_refs")).alias("type"), F.coalesce("score", F.lit(-1.0)).alias("score"))
    return op.accept(r, spark.createDataFrame([("lookup", 30), ("multi_hop", 70)], "type string, quota int"))


@query("qaf_27_quota_acceptance", f"WITH {BASE}, {ACCEPT} SELECT id, type, place, accepted FROM ac")
def qaf_27(spark, sf):
    return accepted(spark, sf).select("id", "type", "place", "accepted")


@query("qaf_28_accepted_counts", f"WITH {BASE}, {ACCEPT} SELECT type, n_refs, count(*) AS n FROM ac WHERE accepted GROUP BY ALL")
def qaf_28(spark, sf):
    return accepted(spark, sf).where("accepted").groupBy("type", "n_refs").agg(F.count("*").alias("n"))


@query("qaf_29_journey_stats", "SELECT event_type, user_id % 3 AS stage, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, user_id % 3), (event_type), ())")
def qaf_29(spark, sf):
    return op.journey_counts(table(spark, sf, "events").withColumn("stage", F.col("user_id") % 3))


@query("qaf_30_style", rf"""WITH {BASE}, t AS (SELECT id, trim(question) AS x, lower(trim(question)) AS l, regexp_extract_all(lower(trim(question)), '[\p{{L}}\p{{N}}_$.:/-]+') AS w FROM qa)
SELECT id, CASE WHEN len(w) = 0 THEN 'keyword' WHEN len(list_filter(w, lambda t: t IN ({', '.join(repr(t) for t in op.EXPERT_TERMS)}))) >= 2 OR (regexp_matches(l, '{op.EXPERT_PATTERN}') AND len(w) >= 5) THEN 'expert'
WHEN contains(x, '?') OR regexp_matches(l, '^({'|'.join(op.STYLE_STARTS)}) ') OR len(w) >= 9 THEN 'natural' WHEN len(w) <= 7 AND l = x THEN 'keyword' ELSE 'natural' END AS style FROM t""")
def qaf_30(spark, sf):
    return rows(spark, sf).select("id", op.style(F.col("question")).alias("style"))


@query("qaf_32_output_row", f"""WITH {BASE} SELECT id, md5('{{"id":' || id || ',"qa_type":"' || qa_type || '"' || CASE WHEN n_refs > 0 THEN ',"n_refs":' || n_refs ELSE '' END || '}}') AS line FROM qa""")
def qaf_32(spark, sf):
    line = op.output_line({"id": F.col("id"), "qa_type": F.col("qa_type"), "n_refs": F.when(F.col("n_refs") > 0, F.col("n_refs"))})
    return rows(spark, sf).select("id", F.md5(line).alias("line"))


@query("qaf_33_stratified_split", f"""WITH {BASE}, s AS (SELECT id, qa_type, lang, count(*) OVER (PARTITION BY qa_type, lang) AS n, row_number() OVER (PARTITION BY qa_type, lang ORDER BY md5('42|' || id), id) AS place FROM qa)
SELECT id, qa_type, lang, CASE WHEN place <= CASE WHEN n > 1 AND floor(n * 0.9) = 0 THEN 1 WHEN n > 1 AND floor(n * 0.9) = n THEN n - 1 ELSE floor(n * 0.9) END THEN 'train' ELSE 'eval' END AS part FROM s""")
def qaf_33(spark, sf):
    return op.stratified_split(rows(spark, sf).select("id", "qa_type", "lang"), ["qa_type", "lang"], 0.9)


@query("qaf_34_early_stop", """WITH b AS (SELECT user_id AS batch, count(*) AS generated, count(*) FILTER (event_type = 'signup' AND value < 12) AS accepted FROM events GROUP BY user_id),
w AS (SELECT batch, sum(generated) OVER r AS g, sum(accepted) OVER r AS a, count(*) OVER r AS k FROM b WINDOW r AS (ORDER BY batch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT batch, round(CASE WHEN g > 0 THEN a / g ELSE 0.0 END, 6) AS rate, k = 3 AND g >= 20 AND a / g < 0.15 AS stop FROM w""")
def qaf_34(spark, sf):
    batches = table(spark, sf, "events").groupBy(F.col("user_id").alias("batch")).agg(F.count("*").alias("generated"), F.count(F.when((F.col("event_type") == "signup") & (F.col("value") < 12), 1)).alias("accepted"))
    return op.early_stop(batches)


@query("qaf_35_batch_sizes", "SELECT l_quantity AS samples, CASE WHEN l_quantity * 20 <= 25 THEN '5/5' WHEN l_quantity * 20 <= 50 THEN '10/5' WHEN l_quantity * 20 <= 100 THEN '10/10' WHEN l_quantity * 20 <= 500 THEN '50/10' ELSE '50/20' END AS size FROM (SELECT DISTINCT l_quantity FROM lineitem)")
def qaf_35(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_quantity").alias("samples")).distinct().select("samples", op.batch_size(F.col("samples") * 20).alias("size"))


@query("qaf_44_meta_questions", f"WITH {BASE} SELECT id, {META} AS meta FROM qa")
def qaf_44(spark, sf):
    return rows(spark, sf).select("id", op.is_meta(F.col("question"), F.col("answer")).alias("meta"))


@query("qaf_02_styles", "WITH w(key, weight) AS (VALUES ('keyword', 0.35), ('natural', 0.45), ('expert', 0.20)), q AS (SELECT key, weight::DOUBLE AS weight, 41 * weight::DOUBLE / sum(weight::DOUBLE) OVER () AS quota FROM w), r AS (SELECT key, floor(quota) AS base, row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, weight DESC, key DESC) AS place, sum(floor(quota)) OVER () AS given FROM q) SELECT key, (base + CASE WHEN place <= 41 - given THEN 1 ELSE 0 END)::BIGINT AS n FROM r")
def qaf_02(spark, sf):
    shares = zip(("keyword", "natural", "expert"), op.STYLE_SHARES["lookup"], strict=True)
    return op.apportioned(spark.createDataFrame(list(shares), "key string, weight double"), 41)


@query("qaf_15_lopsided", r"""WITH r AS (SELECT doc_id // 3 AS qid, list_distinct(regexp_extract_all(lower(first_value(substr(text, 1, 150)) OVER (PARTITION BY doc_id // 3 ORDER BY doc_id)), '[\p{L}\p{N}_]+')) AS a, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
c AS (SELECT qid, CASE WHEN len(a) > 0 THEN len(list_intersect(a, w)) / len(a) ELSE 0.0 END AS c FROM r) SELECT qid, bool_or(c > 0.6) AND bool_or(c < 0.15) AS lopsided FROM c GROUP BY qid""")
def qaf_15(spark, sf):
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 3).alias("qid"), "doc_id", "text")
    first = d.groupBy("qid").agg(F.min_by(F.substring("text", 1, 150), "doc_id").alias("answer"))
    return op.lopsided(d.join(first, "qid"))


@query("qaf_16_subsets", """WITH r AS (SELECT doc_id // 3 AS qid, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT qid, 'primary_only' AS name, ids[1]::VARCHAR AS ids FROM r UNION ALL SELECT qid, 'without_' || x, array_to_string(list_filter(ids, lambda y: y <> x), ',') FROM (SELECT qid, ids, unnest(ids) AS x FROM r)""")
def qaf_16(spark, sf):
    return op.subsets(table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 3).alias("qid"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id")))


@query("qaf_23_regeneration_hops", f"WITH {BASE} SELECT id, CASE WHEN j % 2 = 0 THEN least(n_refs + 1, 3) ELSE n_refs END AS hops FROM qa")
def qaf_23(spark, sf):
    reason = F.when(F.col("j") % 2 == 0, "too_easy").otherwise("unsupported")
    return rows(spark, sf).select("id", op.next_hops(reason, F.col("n_refs"), 3).alias("hops"))
