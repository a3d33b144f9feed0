"""Queries that link documents: the primary is the lowest doc_id of a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.greedy import cut
from ..functions.setjoin import shuffles_dropped
from ..operators import linking as op
from ..operators import profile as prof
from .profile import EDGES, PAIRS, QUALITY, chunks, entities, total
from .registry import query, table

HEAD = "hd AS (SELECT doc_id AS id, source AS file, text FROM documents)"
TOK = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \t\r\n\x0b\x0c]+'), lambda x: x <> ''))"
HITS = "hi AS (SELECT p.pid, d.doc_id AS id, ((d.doc_id * 7 + p.pid * 3) % 97) / 10 AS score FROM (SELECT min(doc_id) AS pid FROM documents GROUP BY source) p, documents d)"
CAND = f"""pp AS (SELECT id AS pid, file AS pfile, text AS ptext FROM hd), ca AS (SELECT pid, id, score, file, text, ptext FROM hi JOIN hd USING (id) JOIN pp USING (pid) WHERE pid <> id AND file <> pfile AND length(text) >= 400 AND id % 10 <> 3)"""
COH = f"""co AS (SELECT *, len(list_intersect(pw, w)) / (len(pw) + len(w) - len(list_intersect(pw, w))) AS overlap FROM (SELECT *, {TOK.format('ptext')} AS pw, {TOK.format('text')} AS w FROM ca)), cb AS (SELECT * FROM co WHERE overlap BETWEEN 0.05 AND 0.55)"""
RANK = """rk AS (SELECT pid, id, text, w, composite, row_number() OVER (PARTITION BY pid ORDER BY composite DESC, id)::INT AS rank FROM (SELECT *, round(((1 - b) * (0.4 * CASE WHEN m > 0 THEN score / m ELSE 0 END + 0.3 * overlap + 0.3 * (id % 5) / 5) + b)::DOUBLE, 6) AS composite
FROM (SELECT *, max(score) OVER (PARTITION BY pid) AS m, CASE WHEN id % 6 = 0 THEN 0.3 ELSE 0.0 END AS b FROM cb)))"""


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), "text")


def cands(spark, sf):
    d = docs(spark, sf)
    primary = d.groupBy("file").agg(F.min("id").alias("pid")).select("pid")
    hits = d.select("id").crossJoin(F.broadcast(primary)).select("pid", "id", ((F.col("id") * 7 + F.col("pid") * 3) % 97 / 10).alias("score"))
    return op.candidates(hits, d, d.where("id % 10 = 3").select("id"), primaries=primary)


def rank(spark, sf):
    rows = op.coherent(cands(spark, sf), 0.05)
    return op.ranked(rows, F.when(F.col("id") % 6 == 0, 0.3).otherwise(0.0), F.col("id") % 5 / 5)


@query("lnk_01_link_queries", """WITH u AS (SELECT doc_id AS id, source AS query, 0 AS kind, 0 AS pos FROM documents UNION ALL SELECT doc_id, w[i], 1, i FROM (SELECT doc_id, list_slice(regexp_extract_all(text, '[A-Z][a-z]+'), 1, 12) AS w, unnest(generate_series(1, 12))::INT AS i FROM documents) WHERE i <= len(w)),
o AS (SELECT id, lower(query) AS q, min((kind, pos, query)) AS s FROM u WHERE trim(query) <> '' GROUP BY 1, 2) SELECT * FROM (SELECT id, s[3] AS query, row_number() OVER (PARTITION BY id ORDER BY s[1], s[2], q)::INT AS rank FROM o) WHERE rank <= 10""")
def lnk_01(spark, sf):
    d = docs(spark, sf)
    names = F.slice(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), 1, 12)
    found = d.select("id", F.posexplode(names).alias("pos", "query")).select("id", "query", (F.col("pos") + 1).alias("pos"))
    return op.link_queries([d.select("id", F.col("file").alias("query"), F.lit(0).alias("pos")), found])


@query("lnk_01b_built_queries", """WITH w AS (SELECT doc_id AS id, regexp_extract_all(text, '[A-Z][a-z]+') AS w, regexp_extract_all(text, '[0-9]+') AS d FROM documents), f AS (SELECT id, list_slice(w, 1, 4) AS n, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 2) AS a, list_slice(list_filter(d, lambda x, i: list_position(d, x) = i), 1, 2) AS b FROM w)
SELECT id, n[i] || ' ' || n[j] AS query FROM f, (SELECT unnest([1, 1, 1, 2, 2, 3]) AS i, unnest([2, 3, 4, 3, 4, 4]) AS j) WHERE j <= len(n) UNION ALL SELECT id, unnest(list_concat(a, b)) FROM f""")
def lnk_01b(spark, sf):
    d = docs(spark, sf)
    names = d.select("id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("names"))
    return op.pair_queries(names).select("id", "query").union(op.pattern_queries(d, ["[A-Z][a-z]+", "[0-9]+"]).select("id", "query"))


@query("lnk_02_fallback_queries", r"""WITH r AS (SELECT doc_id, text, regexp_extract_all(text, '(\p{Lu}[\p{Ll}]+(?: \p{Lu}[\p{Ll}]+)*)', 1) AS w FROM documents)
SELECT doc_id AS id, substr(trim(regexp_extract(text, '^([^.!?]*)', 1)), 1, 120) AS sentence, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS phrase FROM r""")
def lnk_02(spark, sf):
    return docs(spark, sf).select("id", op.fallback_query(F.col("text")).alias("sentence"), op.longest_capitalised(F.col("text")).alias("phrase"))


@query("lnk_03_candidates", f"WITH {HEAD}, {HITS}, {CAND} SELECT pid, id, score FROM ca")
def lnk_03(spark, sf):
    return cands(spark, sf).select("pid", "id", "score")


@query("lnk_04_coherence_band", f"WITH {HEAD}, {HITS}, {CAND}, {COH} SELECT pid, id, round(overlap, 6) AS overlap FROM cb")
def lnk_04(spark, sf):
    return op.coherent(cands(spark, sf), 0.05).select("pid", "id", F.round("overlap", 6).alias("overlap"))


@query("lnk_05_composite_rank", f"WITH {HEAD}, {HITS}, {CAND}, {COH}, {RANK} SELECT pid, id, composite, rank FROM rk")
def lnk_05(spark, sf):
    return rank(spark, sf).select("pid", "id", "composite", "rank")


@query("lnk_06_diverse_pick")
def lnk_06(spark, sf):
    return op.diverse(rank(spark, sf))


@query("lnk_08_date_rerank", f"""WITH {HEAD}, {HITS}, {CAND}, {COH}, {RANK}, d AS (SELECT *, id % 40 AS days, max(id % 40) OVER (PARTITION BY pid) AS md, count(*) OVER (PARTITION BY pid) AS n FROM rk)
SELECT pid, id, round((0.7 * CASE WHEN n > 1 THEN 1 - (rank - 1) / (n - 1) ELSE 1.0 END + 0.3 * CASE WHEN md > 0 THEN days / md ELSE 0 END)::DOUBLE, 6) AS score FROM d""")
def lnk_08(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("pid")
    rows = rank(spark, sf).withColumn("days", F.col("id") % 40)
    rows = rows.withColumn("md", F.max("days").over(w)).withColumn("n", F.count("*").over(w))
    return rows.select("pid", "id", op.date_rerank(F.col("rank"), F.col("n"), F.col("days"), F.col("md")).alias("score"))


@query("lnk_09_index_proximity", """WITH c AS (SELECT doc_id AS id, source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx FROM documents)
SELECT a.id AS pid, b.id, (5 - abs(a.idx - b.idx) + 1)::INT AS score FROM c a JOIN c b ON a.file = b.file AND abs(a.idx - b.idx) BETWEEN 2 AND 5""")
def lnk_09(spark, sf):
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("file").orderBy("id"))
    c = docs(spark, sf).select("id", "file", idx.alias("idx"))
    near = c.select(F.col("id").alias("pid"), "file", F.col("idx").alias("pidx"), F.explode(F.expr("array(-5, -4, -3, -2, 2, 3, 4, 5)")).alias("step"))
    rows = near.join(c, (near["file"] == c["file"]) & (F.col("pidx") + F.col("step") == F.col("idx")))
    return rows.select("pid", "id", op.gap_score(F.abs("step")).alias("score"))


@query("lnk_11_graph_scores", f"""WITH {EDGES}, k AS (SELECT ed.name, id, CASE WHEN length(ed.name) % 2 = 0 THEN 0.5 ELSE 0.8 END AS q FROM ed), z AS (SELECT id, count(*) AS n, sum(q) AS t FROM k GROUP BY id),
s AS (SELECT x.id AS pid, y.id, sum(x.q) AS s FROM k x JOIN k y ON x.name = y.name AND x.id <> y.id GROUP BY ALL)
SELECT s.pid, s.id, round((s.s / p.n)::DOUBLE, 9) AS shared, round(((z.t - s.s) / z.n)::DOUBLE, 9) AS new FROM s JOIN z p ON s.pid = p.id JOIN z ON s.id = z.id""")
def lnk_11(spark, sf):
    with shuffles_dropped(spark):
        names = cut(entities(spark, sf))
        edges = prof.entity_edges(chunks(spark, sf), names)
        quality = names.where("length(name) % 2 = 1").withColumn("q", F.lit(0.8))
        return op.graph_scores(edges, quality, digits=9)


@query("lnk_11b_linked_candidates", f"""WITH {EDGES}, {PAIRS}, k AS (SELECT ed.name, id FROM ed), z AS (SELECT id, count(*) AS n FROM k GROUP BY id), pr2 AS (SELECT min(doc_id) AS pid FROM documents GROUP BY source),
s AS (SELECT x.id AS pid, y.id, count(*) AS s FROM k x JOIN pr2 ON x.id = pid JOIN k y ON x.name = y.name AND x.id <> y.id GROUP BY ALL), bo AS (SELECT a, b, n_chunks AS c FROM pr UNION ALL SELECT b, a, n_chunks FROM pr),
r AS (SELECT s.pid, s.id, 0.5 * s.s / p.n AS shared, 0.5 * (z.n - s.s) / z.n AS new, (d.source <> e.source)::INT AS apart FROM s JOIN z p ON s.pid = p.id JOIN z ON s.id = z.id JOIN documents d ON d.doc_id = s.id JOIN documents e ON e.doc_id = s.pid WHERE length(d.text) >= 400
 AND (SELECT len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v))) FROM (SELECT {TOK.format('d.text')} AS u, {TOK.format('e.text')} AS v)) <= 0.55),
m AS (SELECT r.pid, r.id, sum(coalesce(c, 0)) / count(*) AS mean FROM r JOIN k x ON x.id = r.pid JOIN k y ON y.id = r.id AND x.name <> y.name LEFT JOIN bo ON a = x.name AND b = y.name GROUP BY ALL)
SELECT r.pid, r.id, round((0.3 * shared + 0.3 * new + 0.2 * coalesce(least(1.0, mean / greatest((SELECT max(c) FROM bo) * 0.1, 1.0)), 0) + 0.2 * apart)::DOUBLE, 9) AS score FROM r LEFT JOIN m ON m.pid = r.pid AND m.id = r.id""")
def lnk_11b(spark, sf):
    d = docs(spark, sf)
    edges = cut(prof.entity_edges(chunks(spark, sf), entities(spark, sf)).repartition("id"))
    primary = d.groupBy("file").agg(F.min("id").alias("id")).select("id")
    scores = op.graph_scores(edges, edges.select("name", F.lit(0.5).alias("q")).distinct(), primary, digits=12)
    return op.linked_candidates(scores, prof.co_occurrence(edges), edges, d, digits=9, primaries=primary.withColumnRenamed("id", "pid"))


@query("wik_06b_page_scores", """WITH a AS (SELECT p.pid, d.doc_id AS id, lower(d.text) AS t, d.doc_id = p.pid AS first FROM (SELECT min(doc_id) AS pid, source FROM documents GROUP BY source) p JOIN documents d ON d.source = p.source AND d.doc_id <= p.pid + 60),
n AS (SELECT DISTINCT lang AS title, lower(substr(text, 1, 3 + doc_id % 3)) AS name FROM documents WHERE doc_id % 10 = 0), h AS (SELECT pid, title, CASE WHEN first THEN 2.0 ELSE 1.0 END AS s FROM a JOIN n ON length(name) >= 3 AND contains(t, name)),
m AS (SELECT pid, lang AS title, CASE WHEN first THEN 3.0 ELSE 1.5 END AS s FROM a JOIN documents ON doc_id = id WHERE doc_id % 3 = 0) SELECT pid, title, sum(s)::DOUBLE AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM m) GROUP BY ALL""")
def wik_06b(spark, sf):
    d = table(spark, sf, "documents")
    pages = d.where("doc_id % 3 = 0").groupBy(F.col("lang").alias("title")).agg(F.collect_list("doc_id").alias("ids"))
    names = d.where("doc_id % 10 = 0").select(F.col("lang").alias("title"), F.expr("substr(text, 1, cast(3 + doc_id % 3 as int))").alias("name"))
    first = d.groupBy("source").agg(F.min("doc_id").alias("pid"))
    anchors = d.join(first, "source").where("doc_id <= pid + 60").select("pid", F.col("doc_id").alias("id"), "text", (F.col("doc_id") == F.col("pid")).alias("primary"))
    return op.page_scores(pages, names, anchors)


@query("lnk_14_rollout_parsing", r"""WITH t AS (SELECT item_id, '<tool_call>{"name":"search","arguments":{"query":"' || regexp_extract(text, '[A-Za-z]+') || '"}}</tool_call> x <tool_call>bad</tool_call> <Evidence_Chain> ' || substr(text, 1, 20) || ' </evidence_chain>' AS x FROM benchmark)
SELECT item_id, array_to_string(list_filter(list_transform(regexp_extract_all(x, '(?s)<tool_call>(.*?)</tool_call>', 1), lambda c: CASE WHEN json_valid(c) THEN json_extract_string(c, '$.arguments.query') END), lambda q: q IS NOT NULL AND q <> ''), ';') AS queries, trim(regexp_extract(x, '(?is)<evidence_chain>(.*?)</evidence_chain>', 1)) AS chain FROM t""")
def lnk_14(spark, sf):
    text = F.concat(F.lit('<tool_call>{"name":"search","arguments":{"query":"'), F.regexp_extract("text", "[A-Za-z]+", 0), F.lit('"}}</tool_call> x <tool_call>bad</tool_call> <Evidence_Chain> '), F.substring("text", 1, 20), F.lit(" </evidence_chain>"))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(op.rollout_queries(text), ";").alias("queries"), op.evidence_chain(text).alias("chain"))


@query("lnk_17_confidence", f"WITH {HEAD}, {HITS}, {CAND} SELECT pid, least(1.0, count(*) / 40) AS confidence FROM ca GROUP BY pid")
def lnk_17(spark, sf):
    return cands(spark, sf).groupBy("pid").agg(F.count("*").alias("n")).select("pid", op.confidence(F.col("n"), F.lit(40)).alias("confidence"))


@query("wik_01_clusters", f"WITH {EDGES}, g AS (SELECT name, round(count(*) / n, 6) AS df, count(*) AS c FROM ed, (SELECT count(*) AS n FROM documents) GROUP BY name, n) SELECT name, c AS n_chunks FROM g WHERE 0.4 * ({QUALITY}) + 0.2 + 0.28 > 0.75 AND df < 0.4 AND c BETWEEN 3 AND 120")
def wik_01(spark, sf):
    edges = prof.entity_edges(chunks(spark, sf), entities(spark, sf))
    g = prof.graph_stats(edges, total(spark, sf))
    q = prof.entity_quality(F.col("df"), F.lit("entity"), F.lit("somename"), F.lit(0.0), [])
    return op.clusters(edges, g.withColumn("q", q), most=120)


@query("wik_03_round_robin", "WITH r AS (SELECT doc_id AS id, source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS round, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) SELECT id, file, round FROM r ORDER BY round, f, id LIMIT 45")
def wik_03(spark, sf):
    return op.round_robin(docs(spark, sf), 45)


@query("wik_05_cross_links", f"WITH {EDGES}, p AS (SELECT name AS title, (SELECT text FROM documents WHERE doc_id = length(name) * 3) AS text FROM ent) SELECT a.title, b.title AS \"to\" FROM p a JOIN p b ON a.title <> b.title AND contains(lower(a.text), lower(b.title))")
def wik_05(spark, sf):
    names = entities(spark, sf).select(F.col("name").alias("title"), (F.length("name") * 3).cast("bigint").alias("id"))
    return op.cross_links(names.join(docs(spark, sf), "id").select("title", "text"))


@query("wik_06_context_budget", """WITH p AS (SELECT doc_id % 7 AS pid, 'p' || doc_id AS title, n_chars // 4 AS t, (doc_id % 5) / 2 AS score FROM documents), r AS (SELECT *, 3000 - coalesce(sum(t) OVER (PARTITION BY pid ORDER BY score DESC, title ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM p)
SELECT pid, title, least(t, l)::BIGINT AS used, t > l AS cut FROM r WHERE (t <= l OR l > 100) AND least(t, l) > 0""")
def wik_06(spark, sf):
    i = F.col("doc_id")
    pages = table(spark, sf, "documents").select((i % 7).alias("pid"), F.concat(F.lit("p"), i.cast("string")).alias("title"), "n_chars", (i % 5 / 2).alias("score"))
    return op.within_budget(pages, 3000)
