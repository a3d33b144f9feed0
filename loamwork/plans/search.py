"""Queries on predicates and retrieval: benchmark items ask, documents and embeddings answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sampling import sample
from ..functions.text import first_nonempty
from ..operators import predicates as pred
from ..operators import search as op
from ..operators.linking import fallback_query, longest_capitalised
from .registry import query, table

RULES = {"and": [{"field": "o_orderstatus", "op": "in", "value": ["F", "O"]}, {"or": [{"field": "o_totalprice", "op": "gte", "value": 200000.0}, {"not": {"field": "o_orderpriority", "op": "eq", "value": "1-URGENT"}}]}, {"field": "o_custkey", "op": "lte", "value": 800}, {"bad": 1}]}


@query("prd_01_compiled_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND (o_totalprice >= 200000.0 OR NOT o_orderpriority = '1-URGENT') AND o_custkey <= 800")
def prd_01(spark, sf):
    return table(spark, sf, "orders").where(pred.compile(pred.parse(RULES))).select("o_orderkey", "o_custkey")


ARRAY_RULES = {"and": [{"field": "tags", "op": "contains_any", "value": ["en", "src1"]}, {"not": {"field": "tags", "op": "contains_all", "value": ["en", "src1"]}}]}


@query("prd_02_array_filter", "SELECT doc_id FROM documents WHERE (lang = 'en' OR source = 'src1') AND NOT (lang = 'en' AND source = 'src1')")
def prd_02(spark, sf):
    return table(spark, sf, "documents").withColumn("tags", F.array("lang", "source")).where(pred.compile(pred.parse(ARRAY_RULES))).select("doc_id")


@query("prd_07_negation", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity >= 10 AND (l_discount <= 0.05 OR l_returnflag = 'N'))")
def prd_07(spark, sf):
    rule = pred.Not(pred.And((pred.Field("l_quantity", "gte", 10), pred.Or((pred.Field("l_discount", "lte", 0.05), pred.Field("l_returnflag", "eq", "N"))))))
    return table(spark, sf, "lineitem").where(pred.compile(pred.negated(rule))).select("l_orderkey", "l_linenumber")


W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
BM25 = rf"""d AS (SELECT doc_id AS id, lang, {W.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM d),
q AS (SELECT DISTINCT item_id AS qid, unnest({W.format('substr(text, 1, 1024)')}) AS term FROM benchmark),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s)"""


def items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def corpus(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query("srh_01_bm25", f"WITH {BM25} SELECT qid, id, score, rank FROM bm WHERE rank <= 10")
def srh_01(spark, sf):
    return op.bm25(corpus(spark, sf), items(spark, sf))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, sf):
    """The stated query set: every row whose id is divisible by 20, against all rows."""
    return vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))


VEC = """v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT b.id AS qid, a.id, a.label, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE b.id % 20 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM c)"""


@query("srh_02_vector_top_k", f"WITH {VEC} SELECT qid, id, score, rank FROM vr WHERE rank <= 10")
def srh_02(spark, sf):
    return op.vector_search(vectors(spark, sf), vector_queries(spark, sf))


@query("srh_03_distance_score", "SELECT event_id, CASE WHEN value - 10 < 0 THEN 0.0 ELSE 1.0 / (1.0 + (value - 10)) END AS score FROM events")
def srh_03(spark, sf):
    return table(spark, sf, "events").select("event_id", op.distance_score(F.col("value") - 10).alias("score"))


LEX = "lx AS (SELECT b.vec_id AS qid, a.vec_id AS id, row_number() OVER (PARTITION BY b.vec_id ORDER BY abs(a.label - b.label), a.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0)"


def label_list(spark, sf, k):
    """Rows by the distance of labels, then id.

    The list depends on a query's label only, so it is made once per label, of
    the k smallest ids of every label; a label is an integer, so lists are made
    of its neighbours outwards: k labels on either side always hold k rows.
    """
    rows = vectors(spark, sf).select("id", "label")
    w = Window.partitionBy("label").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("id", "label")
    order = rows.select("label").distinct().groupBy().agg(F.array_sort(F.collect_set("label")).alias("all"))
    at = F.array_position("all", F.col("ql"))
    near = rows.where("id % 20 = 0").select(F.col("label").alias("ql")).distinct().join(F.broadcast(order))
    near = near.select("ql", F.explode(F.slice("all", F.greatest(F.lit(1), at - k), F.lit(2 * k + 1))).alias("label"))
    lists = op.top(near.join(few, "label").select("ql", "id", (-F.abs(F.col("label") - F.col("ql"))).alias("score")), k, by="ql")
    return rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("label").alias("ql")).join(lists, "ql").select("qid", "id", "score", "rank")


def fused(base: int, w1: float, w2: float, depth: int) -> str:
    return f"""WITH {VEC}, {LEX}, u AS (SELECT qid, id, {w1} / (60 + rank - 1 + {base}) AS s FROM vr WHERE rank <= {depth} UNION ALL SELECT qid, id, {w2} / (60 + rank - 1 + {base}) FROM lx WHERE rank <= {depth}),
g AS (SELECT qid, id, round(sum(s), 9) AS score FROM u GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM g) WHERE rank <= 10"""


@query("srh_04_weighted_fusion", fused(1, 0.7, 0.3, 20))
def srh_04(spark, sf):
    return op.fuse([(op.vector_search(vectors(spark, sf), vector_queries(spark, sf), 20), 0.7), (label_list(spark, sf, 20), 0.3)], 10)


@query("srh_05_zero_based_fusion", fused(0, 1.0, 1.0, 20))
def srh_05(spark, sf):
    return op.fuse([(op.vector_search(vectors(spark, sf), vector_queries(spark, sf), 20), 1.0), (label_list(spark, sf, 20), 1.0)], 10, rank_base=0)


@query("srh_06_deep_fusion", fused(1, 1.0, 1.0, 200))
def srh_06(spark, sf):
    return op.fuse([(op.vector_search(vectors(spark, sf), vector_queries(spark, sf), 200), 1.0), (label_list(spark, sf, 200), 1.0)], 10)


@query("srh_07_filtered_search", f"WITH {VEC}, x AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM c WHERE label IN (1, 2, 3)) SELECT * FROM x WHERE rank <= 5")
def srh_07(spark, sf):
    rule = pred.compile(pred.parse({"field": "label", "op": "in", "value": [1, 2, 3]}))
    return op.vector_search(vectors(spark, sf), vector_queries(spark, sf), 5, where=rule)


CHUNKS = "ch AS (SELECT doc_id AS id, source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT - 1 AS idx FROM documents)"


def chunks(spark, sf):
    idx = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), idx.alias("idx"), F.col("text").alias("content"))


ASKED = r"""asked AS (SELECT * FROM (SELECT doc_id * 2 AS item_id, substr(trim(regexp_extract(text, '^([^.!?]*)', 1)), 1, 120) AS text FROM documents WHERE doc_id % 20 = 0
UNION ALL SELECT doc_id * 2 + 1, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] FROM (SELECT doc_id, regexp_extract_all(text, '(\p{Lu}[\p{Ll}]+(?: \p{Lu}[\p{Ll}]+)*)', 1) AS w FROM documents WHERE doc_id % 20 = 0)) WHERE text IS NOT NULL)"""


@query("srh_09_related", f"""WITH {ASKED}, {BM25.replace('FROM benchmark', 'FROM asked')}, {CHUNKS}, h AS (SELECT qid // 2 AS qid, qid AS query, id, score FROM bm WHERE rank <= 30),
r AS (SELECT h.qid, h.id, count(DISTINCT query) AS n_queries, max(score) AS max_score, max((a.file = b.file)::INT) AS same_file FROM h JOIN ch a ON h.id = a.id JOIN ch b ON b.id = h.qid
WHERE h.id <> h.qid AND (SELECT text FROM documents WHERE doc_id = h.id) <> (SELECT text FROM documents WHERE doc_id = h.qid) AND NOT (a.file = b.file AND abs(a.idx - b.idx) <= 1) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n_queries DESC, same_file, max_score DESC, id)::INT AS rank FROM r) WHERE rank <= 10""")
def srh_09(spark, sf):
    """Primaries are the stated query set, ids divisible by 20; each asks its first sentence and its longest capitalised phrase."""
    asked = corpus(spark, sf).where("id % 20 = 0")
    queries = asked.select((F.col("id") * 2).alias("qid"), fallback_query(F.col("text")).alias("text"))
    queries = queries.union(asked.select(F.col("id") * 2 + 1, longest_capitalised(F.col("text")))).where("text IS NOT NULL")
    hits = op.bm25(corpus(spark, sf), queries, 30).select(F.floor(F.col("qid") / 2).alias("qid"), F.col("qid").alias("query"), "id", "score")
    return op.related(hits, chunks(spark, sf), asked.select(F.col("id").alias("qid"), F.col("id").alias("pid")), 10)


@query("srh_11_sample_chunks", "SELECT doc_id FROM documents WHERE length(text) >= 400 ORDER BY md5('42|' || doc_id), doc_id LIMIT 25")
def srh_11(spark, sf):
    return sample(table(spark, sf, "documents").where("length(text) >= 400"), 25, 42, "doc_id").select("doc_id")


@query("srh_12_chunk_count", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def srh_12(spark, sf):
    return op.chunk_count(table(spark, sf, "documents"), "source")


@query("srh_13_file_chunks", f"WITH {CHUNKS} SELECT file, count(*) AS n_chunks, string_agg(id, ',' ORDER BY idx) AS ids FROM ch GROUP BY file")
def srh_13(spark, sf):
    return op.file_chunks(chunks(spark, sf)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("srh_14_content_projection", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '{"page_id":' || page_id || ',"url":"' || url || '"}' END AS content FROM pages""")
def srh_14(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, op.content_of("url")).otherwise(op.content_of("page_id", "url")).alias("content"))


@query("srh_16_field_renaming", "SELECT doc_id AS chunk_id, source AS file_path, n_chars AS char_count FROM documents")
def srh_16(spark, sf):
    names = {"doc_id": "chunk_id", "source": "file_path", "n_chars": "char_count"}
    return op.renamed(table(spark, sf, "documents").select(*names), names)


@query("srh_17_dimensions", "SELECT len(embedding)::INT AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def srh_17(spark, sf):
    return op.dimensions(op.checked_dimension(vectors(spark, sf), 64))


@query("srh_10_search_texts", f"WITH {BM25} SELECT qid, id, rank, md5(text) AS content FROM bm JOIN documents ON id = doc_id WHERE rank <= 3")
def srh_10(spark, sf):
    found = op.search_texts(op.bm25(corpus(spark, sf), items(spark, sf), 3), corpus(spark, sf).withColumnRenamed("text", "content"))
    return found.select("qid", "id", "rank", F.md5("content").alias("content"))


_STOP = ", ".join(f"'{w}'" for w in op.STOP_WORDS)


@query("srh_18_query_rewrite", rf"""WITH x AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'How do I use "' || substr(text, 1, 12) || '" site:a.org? ' || text ELSE 'What is ' || substr(text, 1, 60) END AS q FROM benchmark),
n AS (SELECT item_id, trim(regexp_replace(q, '[ \t\r\n\x0b\x0c]+', ' ', 'g')) AS q FROM x),
a AS (SELECT item_id, q, list_transform(list_filter(list_transform(regexp_extract_all(q, '"([^"]+)"', 1), lambda p: trim(p)), lambda p: length(p) >= 2), lambda p: '"' || p || '"') AS ph,
 list_filter(regexp_extract_all(regexp_replace(regexp_replace(q, '"[^"]+"', ' ', 'g'), '[?!,;(){{}}\[\]]', ' ', 'g'), '[A-Za-z0-9$@._:/-]+'), lambda t: t IN ('AND', 'OR', 'NOT') OR (lower(t) NOT IN ({_STOP}) AND (length(t) > 1 OR regexp_full_match(t, '[0-9]')))) AS tk FROM n),
b AS (SELECT item_id, q, ph, list_filter(tk, lambda t, i: list_position(list_transform(tk, lambda y: lower(y)), lower(t)) = i) AS tk FROM a),
c AS (SELECT item_id, q, array_to_string(list_slice(list_concat(list_concat(list_filter(tk, lambda t: starts_with(lower(t), 'site:')), ph), list_filter(tk, lambda t: NOT starts_with(lower(t), 'site:'))), 1, 16), ' ') AS r FROM b)
SELECT item_id, CASE WHEN r = '' THEN q WHEN length(r) <= 140 THEN r ELSE regexp_replace(substr(r, 1, 140), ' [^ ]*$', '') END AS query FROM c""")
def srh_18(spark, sf):
    q = F.expr("""CASE WHEN item_id % 3 = 0 THEN concat('How do I use "', substr(text, 1, 12), '" site:a.org? ', text) ELSE concat('What is ', substr(text, 1, 60)) END""")
    return table(spark, sf, "benchmark").select("item_id", op.rewrite(q).alias("query"))


@query("srh_19_query_resolution", "SELECT item_id, coalesce(nullif(CASE WHEN item_id % 3 = 0 THEN '' END, ''), nullif(CASE WHEN item_id % 2 = 0 THEN substr(text, 1, 10) END, ''), text) AS query FROM benchmark")
def srh_19(spark, sf):
    explicit = F.when(F.col("item_id") % 3 == 0, F.lit(""))
    rewritten = F.when(F.col("item_id") % 2 == 0, F.substring("text", 1, 10))
    return table(spark, sf, "benchmark").select("item_id", first_nonempty(explicit, rewritten, F.col("text")).alias("query"))


@query("srh_20_rendering", f"""WITH {BM25}, t AS (SELECT qid, string_agg(rank || '. ' || substr(text, 1, 300) || ' (score ' || format('{{:.3f}}', score) || ')', chr(10) ORDER BY rank) AS x FROM bm JOIN documents ON id = doc_id WHERE rank <= 5 GROUP BY qid)
SELECT qid, md5(CASE WHEN length(x) > 900 THEN rtrim(substr(x, 1, 885)) || '... (truncated)' ELSE x END) AS text FROM t""")
def srh_20(spark, sf):
    hits = op.bm25(corpus(spark, sf), items(spark, sf), 5).join(corpus(spark, sf).withColumn("content", F.substring("text", 1, 300)).drop("text"), "id")
    return op.render(hits, 900).withColumn("text", F.md5("text"))
