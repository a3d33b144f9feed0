"""Queries on chunking: documents are chunks, sources their files, pages the mixed markup."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sampling import sample
from ..operators import chunking as op
from ..sources import tables
from .registry import query, table

CH = "ch AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN source || '.md' ELSE lang || '/' || source || '.md' END AS file, lang AS folder, text AS content, doc_id // 20 AS idx FROM documents)"


def chunks(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat("source", F.lit(".md"))
    file = F.when(F.col("doc_id") % 3 == 0, name).otherwise(F.concat("lang", F.lit("/"), name))
    return d.select(F.col("doc_id").alias("id"), file.alias("file"), F.col("lang").alias("folder"), F.col("text").alias("content"), F.floor(F.col("doc_id") / 20).alias("idx"))


@query("chk_01_mdx", r"""SELECT doc_id, md5(regexp_replace(repeat(chr(10), 3) || '```' || chr(10) || 'import Z from ' || chr(39) || 'q' || chr(39) || chr(10) || '```' || repeat(chr(10), 3) || text, '\n\n\n+', chr(10) || chr(10), 'g')) AS text FROM documents""")
def chk_01(spark, sf):
    extra = F.concat(F.lit("import X from 'y'\n\n<!-- c -->\n```\nimport Z from 'q'\n```\n<Box />\n<Wrap> </Wrap>\n"), "text")
    return table(spark, sf, "documents").select("doc_id", F.md5(op.clean_mdx(extra)).alias("text"))


@query("chk_05_markdown_chunks")
def chk_05(spark, sf):
    d = table(spark, sf, "documents").repartition(8, "source")
    head = F.concat(F.lit("# "), F.substring("text", 1, 12), F.lit("\n\n"), "text")
    return op.chunk_markdown(d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file"), head.alias("text"))).select("hash", "file", "idx", F.length("content").alias("n_chars"))


@query("chk_06_repeated_hashes", "SELECT md5(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def chk_06(spark, sf):
    return op.repeated_hashes(table(spark, sf, "documents").select(F.md5("text").alias("hash")))


@query("chk_07_tree_summary", f"WITH {CH} SELECT folder, file, count(*) AS n, min(length(content))::INT AS smallest, max(length(content))::INT AS largest, floor(avg(length(content)))::BIGINT AS mean FROM ch GROUP BY ROLLUP (folder, file)")
def chk_07(spark, sf):
    return op.tree_summary(chunks(spark, sf))


@query("chk_08_neighbours", f"WITH {CH}, w AS (SELECT id, string_agg(id, ',') OVER (PARTITION BY file ORDER BY idx, id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, string_agg(id, ',') OVER (PARTITION BY file ORDER BY idx, id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM ch) SELECT id, coalesce(b, '') AS before, coalesce(a, '') AS after FROM w")
def chk_08(spark, sf):
    return op.neighbours(chunks(spark, sf).withColumn("idx", F.struct("idx", "id")), 2)


@query("chk_09_previews", f"WITH {CH}, w AS (SELECT id, lag(content) OVER (PARTITION BY file ORDER BY idx, id) AS b, lead(content) OVER (PARTITION BY file ORDER BY idx, id) AS a FROM ch) SELECT id, coalesce(CASE WHEN length(b) > 80 THEN '...' || right(b, 80) ELSE b END, '(start of file)') AS before, coalesce(CASE WHEN length(a) > 80 THEN left(a, 80) || '...' ELSE a END, '(end of file)') AS after FROM w")
def chk_09(spark, sf):
    return op.previews(chunks(spark, sf).withColumn("idx", F.struct("idx", "id")))


@query("chk_10_top_level", f"WITH {CH}, d AS (SELECT id, file, length(file) - length(replace(file, '/', '')) AS depth FROM ch) SELECT id, file FROM d WHERE depth = (SELECT min(depth) FROM d)")
def chk_10(spark, sf):
    return op.top_level(chunks(spark, sf)).select("id", "file")


@query("chk_11_lookup", f"WITH {CH} SELECT md5(content) AS hash, max(id) AS id FROM ch GROUP BY 1")
def chk_11(spark, sf):
    return tables.by_hash(chunks(spark, sf))


@query("chk_12_length_filter", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 400 AND 2048")
def chk_12(spark, sf):
    return tables.of_length(table(spark, sf, "documents"), 400, 2048).select("doc_id")


@query("chk_13_sample", "SELECT doc_id FROM documents ORDER BY md5('3|' || doc_id), doc_id LIMIT 15")
def chk_13(spark, sf):
    return sample(table(spark, sf, "documents"), 15, 3, "doc_id").select("doc_id")


@query("chk_14_chunk_positions", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT - 1 AS pos FROM documents")
def chk_14(spark, sf):
    return tables.positions(table(spark, sf, "documents"), "source", "doc_id").select("doc_id", "source", "pos")
