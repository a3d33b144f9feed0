"""Queries that profile documents.  Headers are sources, entities a fixed rule's frequent words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import upper_each
from ..operators import profile as op
from .registry import query, table

W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
STOP = ["the", "and", "that", "this", "with", "from", "der", "die", "und", "les", "des", "que", "para"]
STOPS = ", ".join(f"'{w}'" for w in STOP)
DF = f"tdf AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({W}) AS token FROM documents) WHERE length(token) >= 3 GROUP BY token)"


def chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def total(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"))


@query("prf_01_token_df", f"WITH {DF} SELECT * FROM tdf")
def prf_01(spark, sf):
    return op.token_df(chunks(spark, sf))


KEY = f"""tok AS (SELECT id, token, count(*) AS tf, min(pl) AS pl FROM (SELECT doc_id AS id, unnest(w) AS token, generate_subscripts(w, 1) AS pl FROM (SELECT doc_id, list_filter({W}, lambda x: length(x) >= 4) AS w FROM documents)) GROUP BY ALL),
kdf AS (SELECT token, count(*) AS df FROM tok GROUP BY token), nn AS (SELECT count(*) AS n FROM documents),
kp AS (SELECT id, token, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, pl)::INT AS rank FROM (SELECT id, token, pl, round(tf * ln(n / df), 6) AS score FROM tok JOIN kdf USING (token), nn WHERE df < 0.8 * n))"""


@query("prf_02_keyphrases", f"WITH {KEY} SELECT * FROM kp WHERE rank <= 5")
def prf_02(spark, sf):
    return op.keyphrases(chunks(spark, sf))


ENT = f"""ent AS (SELECT token AS name FROM tdf, (SELECT count(*) AS n FROM documents) WHERE length(token) >= 5 AND df >= 0.02 * n AND df < 0.4 * n)"""


def entities(spark, sf):
    df = op.token_df(chunks(spark, sf), 5).join(F.broadcast(total(spark, sf)))
    return df.where((F.col("df") >= 0.02 * F.col("n")) & (F.col("df") < 0.4 * F.col("n"))).select(F.col("token").alias("name"))


@query("prf_03_entity_patterns", f"""WITH {DF}, {ENT}, u AS (SELECT upper(name) AS name, 'entity' AS type, 0 AS p, length(name) AS pos FROM ent UNION ALL SELECT DISTINCT source, 'code_pattern', 1, length(source) FROM documents UNION ALL SELECT name, 'domain_term', 2, length(name) FROM ent UNION ALL SELECT unnest(['the', 'ab', 'Widget ']), 'domain_term', 2, 1)
SELECT name, type FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY p, pos) AS k FROM (SELECT trim(name) AS name, type, p, pos FROM u) WHERE type = 'code_pattern' OR (length(name) >= 3 AND lower(name) NOT IN ({STOPS}))) WHERE k = 1""")
def prf_03(spark, sf):
    own = entities(spark, sf)
    named = own.select(upper_each(F.col("name")).alias("name"), F.length("name").alias("pos"))
    code = chunks(spark, sf).select(F.col("source").alias("name")).distinct().withColumn("pos", F.length("name"))
    extra = spark.createDataFrame([("the", 1), ("ab", 1), ("Widget ", 1)], "name string, pos int")
    return op.merge_patterns([(named, "entity"), (code, "code_pattern"), (own.withColumn("pos", F.length("name")).union(extra), "domain_term")], STOP)


@query("prf_04_header_entities", "WITH h AS (SELECT doc_id AS id, source AS value FROM documents UNION ALL SELECT doc_id, lang FROM documents) SELECT value AS name, count(DISTINCT id) AS n_chunks FROM h GROUP BY value HAVING count(DISTINCT id) >= 3 AND count(DISTINCT id) <= 0.15 * (SELECT count(*) FROM documents)")
def prf_04(spark, sf):
    rows = chunks(spark, sf)
    headers = rows.select("id", F.explode(F.array("source", "lang")).alias("value")).join(F.broadcast(total(spark, sf)))
    return op.header_entities(headers, F.col("n"))


@query("prf_06_keyphrase_aggregates", f"""WITH {KEY}, f AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'Q' || token ELSE 'q' || token END AS phrase, score, rank AS pos FROM kp WHERE rank <= 5),
o AS (SELECT id, lower(phrase) AS key, min_by(phrase, pos) AS phrase, min_by(score, pos) AS score FROM f GROUP BY 1, 2), g AS (SELECT key, phrase, count(*) AS uses, sum(round(score * 1e6)::BIGINT) AS s FROM o GROUP BY ALL)
SELECT min_by(phrase, (-uses, phrase)) AS name, sum(uses)::BIGINT AS n_chunks, sum(s)::DOUBLE / sum(uses)::DOUBLE / 1e6 AS mean_score FROM g GROUP BY key""")
def prf_06(spark, sf):
    found = op.keyphrases(chunks(spark, sf)).select("id", F.concat(F.when(F.col("id") % 2 == 0, "Q").otherwise("q"), "token").alias("phrase"), "score", F.col("rank").alias("pos"))
    return op.aggregate_keyphrases(found)


@query("prf_08_kinds", r"""SELECT item_id, CASE WHEN regexp_matches(name, '[\\^$*+?{}\[\]|()]') THEN 'code_pattern' WHEN len(list_filter(string_split(name, ' '), lambda w: regexp_matches(w, '^\p{Lu}'))) > 0 THEN 'entity' ELSE 'domain_term' END AS kind
FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN substr(text, 1, 12) WHEN 1 THEN lower(substr(text, 1, 12)) ELSE substr(text, 1, 5) || '(x)' END AS name FROM benchmark)""")
def prf_08(spark, sf):
    name = F.expr("CASE item_id % 3 WHEN 0 THEN substr(text, 1, 12) WHEN 1 THEN lower(substr(text, 1, 12)) ELSE concat(substr(text, 1, 5), '(x)') END")
    return table(spark, sf, "benchmark").select("item_id", op.kind(name).alias("kind"))


EDGES = f"{DF}, {ENT}, ed AS (SELECT name, doc_id AS id FROM ent JOIN documents ON contains(lower(text), lower(name)))"
PAIRS = "pr AS (SELECT x.name AS a, y.name AS b, count(*) AS n_chunks FROM ed x JOIN ed y ON x.id = y.id AND x.name < y.name GROUP BY ALL)"


@query("prf_10_entity_graph", f"WITH {EDGES} SELECT name, count(*) AS n_chunks, round(count(*) / n, 6) AS df, round(ln(n / count(*)), 6) AS idf FROM ed, (SELECT count(*) AS n FROM documents) GROUP BY name, n")
def prf_10(spark, sf):
    return op.graph_stats(op.entity_edges(chunks(spark, sf), entities(spark, sf)), total(spark, sf))


@query("prf_11_co_occurrence", f"WITH {EDGES}, {PAIRS} SELECT * FROM pr")
def prf_11(spark, sf):
    return op.co_occurrence(op.entity_edges(chunks(spark, sf), entities(spark, sf)))


QUALITY = f"""CASE WHEN df <= 0 THEN 0.0 WHEN df < 0.02 THEN df / 0.02 WHEN df <= 0.10 THEN 1.0 WHEN df <= 0.40 THEN 1 - (df - 0.10) / 0.30 ELSE 0.0 END"""


@query("prf_12_entity_quality", f"""WITH {EDGES}, g AS (SELECT name, round(count(*) / n, 6) AS df, CASE length(name) % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'code_pattern' ELSE 'domain_term' END AS kind, CASE WHEN length(name) % 2 = 0 THEN 0.3 ELSE 0.0 END AS sem FROM ed, (SELECT count(*) AS n FROM documents) GROUP BY name, n)
SELECT name, round((0.4 * ({QUALITY}) + 0.2 * CASE kind WHEN 'entity' THEN 1.0 WHEN 'code_pattern' THEN 0.85 ELSE 0.6 END + 0.4 * CASE WHEN sem > 0 THEN least(sem / 0.6, 1.0) WHEN kind = 'code_pattern' THEN 0.8 WHEN name IN ({STOPS}) THEN 0.0 WHEN length(name) < 4 THEN 0.4 ELSE 0.7 END)::DOUBLE, 6) AS quality FROM g""")
def prf_12(spark, sf):
    g = op.graph_stats(op.entity_edges(chunks(spark, sf), entities(spark, sf)), total(spark, sf))
    kind = F.expr("CASE length(name) % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'code_pattern' ELSE 'domain_term' END")
    semantic = F.when(F.length("name") % 2 == 0, 0.3).otherwise(0.0)
    return g.select("name", F.round(op.entity_quality(F.col("df"), kind, F.col("name"), semantic, STOP), 6).alias("quality"))


@query("prf_13_specificity", f"""WITH {EDGES}, {PAIRS}, bo AS (SELECT a AS name, n_chunks AS c FROM pr UNION ALL SELECT b, n_chunks FROM pr), su AS (SELECT name, sum(c) AS t, count(*) AS k FROM bo GROUP BY name)
SELECT name, round(1 - (-sum(c / t * ln(c / t))) / CASE WHEN any_value(k) > 1 THEN ln(any_value(k)) ELSE 1.0 END, 6) AS specificity FROM bo JOIN su USING (name) GROUP BY name""")
def prf_13(spark, sf):
    return op.specificity(op.co_occurrence(op.entity_edges(chunks(spark, sf), entities(spark, sf))))


@query("prf_14_band", f"WITH {EDGES}, g AS (SELECT name, count(*) / (SELECT count(*) FROM documents) AS df FROM ed GROUP BY name) SELECT name FROM g WHERE df >= 0.005 AND df < 0.8")
def prf_14(spark, sf):
    return op.band(op.graph_stats(op.entity_edges(chunks(spark, sf), entities(spark, sf)), total(spark, sf), 12))


CEN = rf"""{EDGES}, ne AS (SELECT id, count(*) AS k, sum(CASE WHEN length(name) % 2 = 0 THEN 0.9 ELSE 0.5 END) AS q FROM ed GROUP BY id),
cr AS (SELECT d.doc_id AS id, length(text) AS length, coalesce(k, 0) / greatest(length(text) / 1000, 0.001) AS entity, (coalesce(q, 0) / greatest(length(text) / 1000, 0.001))::DOUBLE AS quality, len(list_distinct(w)) / greatest(len(w), 1) AS diversity, CASE WHEN d.doc_id % 4 = 0 THEN source END AS header, source AS doc_key, d.doc_id // 20 AS idx, CASE WHEN d.doc_id % 3 > 0 THEN '2024-01-01' END AS date FROM (SELECT *, {W} AS w FROM documents) d LEFT JOIN ne ON ne.id = d.doc_id),
o1 AS (SELECT length AS v, row_number() OVER (ORDER BY length) AS k, count(*) OVER () AS n FROM cr), o2 AS (SELECT diversity AS v, row_number() OVER (ORDER BY diversity) AS k, count(*) OVER () AS n FROM cr), o3 AS (SELECT entity AS v, row_number() OVER (ORDER BY entity) AS k, count(*) OVER () AS n FROM cr)"""


def exclusive(t: str, p: float) -> str:
    low = f"greatest(1, least(n - 1, floor({p} * (n + 1))))"
    value = "floor(lo + w * (hi - lo))" if t == "o1" else "round(lo + w * (hi - lo), 6)"
    return f"(SELECT {value} FROM (SELECT max(v) FILTER (k = {low}) AS lo, max(v) FILTER (k = {low} + 1) AS hi, any_value({p}::DOUBLE * (n + 1) - {low}) AS w FROM {t}))"


QUARTILES = ", ".join(f"{exclusive(t, q / 100)} AS {c}_p{q}" for t, c in (("o1", "length"), ("o3", "entity"), ("o2", "diversity")) for q in (25, 50, 75))
CENSUS = f"""cs AS (SELECT count(*) AS n_chunks, round(avg((header IS NOT NULL)::INT), 6) AS header_share, round(avg((doc_key IS NOT NULL)::INT), 6) AS doc_share, round(avg((date IS NOT NULL)::INT), 6) AS date_share, round(avg((idx <> 0)::INT), 6) AS sequence_share, {QUARTILES} FROM cr),
ce AS (SELECT *, CASE WHEN header_share > 0.7 THEN 'structured' WHEN header_share >= 0.2 THEN 'mixed' WHEN doc_share > 0.5 AND date_share > 0.5 THEN 'mixed' ELSE 'unstructured' END AS regime FROM cs)"""


def place_sql(value: str, c: str) -> str:
    return f"""CASE WHEN {value} <= {c}_p25 THEN 0.25 * {value} / greatest({c}_p25, 1e-9) WHEN {value} <= {c}_p50 THEN 0.25 + 0.25 * ({value} - {c}_p25) / greatest({c}_p50 - {c}_p25, 1e-9)
WHEN {value} <= {c}_p75 THEN 0.5 + 0.25 * ({value} - {c}_p50) / greatest({c}_p75 - {c}_p50, 1e-9) ELSE least(1.0, 0.75 + 0.25 * ({value} - {c}_p75) / greatest({c}_p75, 1e-9)) END"""


def census_rows(spark, sf):
    rows = chunks(spark, sf)
    found = op.entity_edges(rows, entities(spark, sf)).withColumn("q", F.when(F.length("name") % 2 == 0, 0.9).otherwise(0.5).cast("decimal(3,1)"))
    counts = found.groupBy("id").agg(F.count("*").alias("n_entities"), F.sum("q").cast("double").alias("quality"))
    rows = rows.join(counts, "id", "left")
    return rows.select("id", "text", F.when(F.col("id") % 4 == 0, F.col("source")).alias("header"), F.col("source").alias("doc_key"), F.floor(F.col("id") / 20).alias("idx"), F.when(F.col("id") % 3 > 0, "2024-01-01").alias("date"), "n_entities", "quality")


@query("prf_15_census", f"WITH {CEN}, {CENSUS} SELECT * FROM ce")
def prf_15(spark, sf):
    return op.census(census_rows(spark, sf))


@query("prf_16_header_prevalence", "SELECT round(avg((doc_id % 4 = 0)::INT), 6) AS header_share FROM documents")
def prf_16(spark, sf):
    return op.header_prevalence(table(spark, sf, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("header")))


@query("prf_17_percentiles", f"WITH {CEN}, {CENSUS} SELECT id, round({place_sql('length', 'length')}, 6) AS place FROM cr, ce")
def prf_17(spark, sf):
    rows = census_rows(spark, sf)
    place = op.normalised(F.length("text"), F.col("length_p25"), F.col("length_p50"), F.col("length_p75"))
    return rows.join(F.broadcast(op.census(rows).drop("header"))).select("id", F.round(place, 6).alias("place"))


FURNITURE = " + ".join("regexp_matches(text, '(?i){}')::INT".format(p.replace("'", "''")) for p in op.BOILERPLATE)
ANSWER = rf"""CASE WHEN text IS NULL OR length(text) < 20 THEN 0.0 ELSE 0.35 * least(1.0, (len(regexp_extract_all(text, '[.!?]([ \t\r\n\x0b\x0c]|$)')) + len(regexp_extract_all(text, '[。！？।]'))) / greatest(length(text) / 1000, 0.001) / 6.0)
 + 0.30 * greatest(0.0, 1 - (length(text) - length(regexp_replace(text, '{op.MARKUP}', '', 'g'))) / length(text) * 3)
 + 0.25 * CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 0 THEN len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 60)) / len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) ELSE 0.0 END
 + 0.10 * greatest(0.0, 1 - ({FURNITURE}) * 0.33) END"""


@query("prf_18_answerability", f"SELECT doc_id, round(({ANSWER})::DOUBLE, 6) AS answerability FROM documents")
def prf_18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(op.answerability(F.col("text")), 6).alias("answerability"))


IDF = "ti AS (SELECT id, avg(ln(n / df)) AS idf FROM (SELECT id, token FROM kp WHERE rank <= 5) JOIN kdf USING (token), nn GROUP BY id)"
SUIT = f"""{CEN}, {CENSUS}, {KEY}, {IDF}, an AS (SELECT doc_id AS id, ({ANSWER})::DOUBLE AS ans FROM documents),
su AS (SELECT id, 0.1::DOUBLE * (((header IS NOT NULL)::INT + (doc_key IS NOT NULL)::INT + (date IS NOT NULL)::INT + (idx <> 0)::INT) / 4) + 0.2::DOUBLE * ({place_sql('quality', 'entity')}) + 0.15::DOUBLE * ({place_sql('diversity', 'diversity')}) + 0.1::DOUBLE * ({place_sql('length', 'length')})
 + 0.15::DOUBLE * least(1.0, coalesce(idf, 0) / greatest(ln(greatest(n, 2)), 0.001)) + 0.3::DOUBLE * ans AS score FROM cr JOIN an USING (id) LEFT JOIN ti USING (id), ce, nn WHERE regime = 'mixed')"""


def suitability(spark, sf):
    rows, n = census_rows(spark, sf), total(spark, sf)
    words = op.keyphrases(chunks(spark, sf))
    df = op.token_df(chunks(spark, sf), 4).join(F.broadcast(n)).select("token", F.log(F.col("n") / F.col("df")).alias("idf"))
    idf = words.join(df, "token").groupBy("id").agg(F.avg("idf").alias("idf"))
    facts = op.census(rows)
    s = op.signals(rows.join(idf, "id", "left"), facts, n)
    names = ("metadata", "entities", "diversity", "length", "tfidf", "answerability")
    return facts, s.select("id", F.round(op.suitability({k: F.col(k) for k in names}, F.col("regime"), F.col("header_share")), 6).alias("score"))


@query("prf_19_suitability", f"WITH {SUIT} SELECT id, round(score, 6) AS score FROM su")
def prf_19(spark, sf):
    return suitability(spark, sf)[1]


@query("prf_20_profile_sample", """WITH r AS (SELECT doc_id AS id, source AS doc_key, md5('42|' || doc_id) AS pin, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS k FROM documents)
SELECT id, doc_key, CASE WHEN k <= 5 THEN 0 ELSE 1 END AS stage FROM r ORDER BY stage, pin, id LIMIT 200""")
def prf_20(spark, sf):
    return op.profile_sample(chunks(spark, sf).withColumn("doc_key", F.col("source")), 200, 20)


@query("prf_22_capabilities", "SELECT max(source IS NOT NULL) AS has_docs, max(doc_id % 4 = 0) AS has_headers, true AS has_sequence, max(doc_id % 3 > 0) AS has_dates, 'factual,inference,temporal,sequential' AS modes FROM documents")
def prf_22(spark, sf):
    i = F.col("doc_id")
    return op.capabilities(table(spark, sf, "documents").select(F.col("source").alias("doc_key"), F.when(i % 4 == 0, F.col("source")).alias("header"), F.floor(i / 20).alias("idx"), F.when(i % 3 > 0, "2024-01-01").alias("date")))


@query("prf_25_auto_tune", f"""WITH {SUIT}, sh AS (SELECT avg((round(score, 6) > 0.4)::INT) AS share FROM su), x AS (SELECT *, least(1.0, CASE regime WHEN 'structured' THEN 1.0 WHEN 'mixed' THEN 0.6 ELSE 0.3 END + CASE WHEN entity_p25 > 0 THEN 0.15 ELSE 0.0 END)::DOUBLE AS l,
 CASE WHEN share < 0.3 THEN 0.0 WHEN share < 0.5 OR length_p50 < 600 THEN 0.2 ELSE 0.4 END::DOUBLE AS more, floor(n_chunks * share) AS pool, CASE WHEN date_share < 0.05 THEN 0 WHEN date_share < 0.3 THEN least(0.25, date_share) ELSE 0.25 END::DOUBLE AS t, CASE WHEN sequence_share < 0.05 THEN 0 WHEN sequence_share < 0.3 THEN least(0.25, sequence_share) ELSE 0.25 END::DOUBLE AS s FROM ce, sh)
SELECT regime, round(l, 2) AS linkability, round(greatest(0.3, 0.7 * l), 2) AS multi_hop, round(1 - round(greatest(0.3, 0.7 * l), 2), 2) AS lookup, round(1.0 - more, 4) AS two_hops, round(more, 4) AS more_hops, CASE WHEN pool > 0 THEN least(100, 2 * pool) ELSE 100 END::BIGINT AS samples,
 round(0.5 / (0.5 + t + s), 4) AS factual, round(t / (0.5 + t + s), 4) AS temporal, round(s / (0.5 + t + s), 4) AS sequential FROM x""")
def prf_25(spark, sf):
    facts, scores = suitability(spark, sf)
    return op.auto_tune(facts, scores.agg(F.avg((F.col("score") > 0.4).cast("int")).alias("share")))


@query("prf_27_eligible_seeds", f"""WITH s AS (SELECT doc_id AS id, round(({ANSWER})::DOUBLE, 6) AS score FROM documents), c AS (SELECT score AS cut FROM (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM s) WHERE k = n // 4 + 1)
SELECT id, score FROM s, c WHERE score > cut ORDER BY md5('42|' || id), id LIMIT 20""")
def prf_27(spark, sf):
    scores = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.round(op.answerability(F.col("text")), 6).alias("score"))
    return op.eligible_seeds(scores)
