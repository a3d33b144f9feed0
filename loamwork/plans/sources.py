"""Queries on table-shaped sources and sinks; file formats are covered by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, tables
from .registry import query, table


@query("src_05_json_fields", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def src_05(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("src_11_trace_count", "SELECT count(DISTINCT conv_id) AS n FROM conversations")
def src_11(spark, sf):
    return tables.trace_count(table(spark, sf, "conversations").select(F.col("conv_id").alias("trace")))


@query("src_14_newest_by_name", "SELECT source AS name, max_by(doc_id, (n_chars, doc_id)) AS id FROM documents GROUP BY source")
def src_14(spark, sf):
    return tables.newest(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), "source", "n_chars")


@query("src_15_upsert_rows", "SELECT doc_id AS id, substr(text, 1, 4000) AS content, source || '/' || lang AS file_path, (doc_id // 20) AS chunk_index, length(text)::INT AS char_count, md5(text) AS content_hash FROM documents")
def src_15(spark, sf):
    d = table(spark, sf, "documents")
    return tables.upsert_rows(d.select(F.col("doc_id").alias("id"), "text", F.concat_ws("/", "source", "lang").alias("file"), F.floor(F.col("doc_id") / 20).alias("idx")))


@query("src_16_keyset_page", "SELECT doc_id FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def src_16(spark, sf):
    return tables.page(table(spark, sf, "documents").select("doc_id"), "doc_id", 100, 50)


@query("src_17_point_lookup", "SELECT doc_id, source FROM documents WHERE doc_id IN (3, 5, 8, 13, 21)")
def src_17(spark, sf):
    wanted = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21, 3)], "doc_id bigint")
    return tables.lookup(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", wanted)


@query("src_19_content_address", """WITH l AS (SELECT '{"item_id":' || item_id || ',"text":' || to_json(text) || '}' AS line FROM benchmark)
SELECT substr(sha256(count(*) || '|' || sum(('0x' || substr(sha256(line), 1, 15))::BIGINT)), 1, 8) AS digest FROM l""")
def src_19(spark, sf):
    return files.content_address(table(spark, sf, "benchmark"))


@query("ckp_03_resume_state", "SELECT event_type, count(*) AS n, max(event_id) AS last_id, count(*) FILTER (event_id % 10 = 0) AS n_bad FROM events GROUP BY event_type")
def ckp_03(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), (F.col("event_id") % 10 == 0).alias("bad"))
    return tables.resume_state(log).withColumnRenamed("kind", "event_type")


@query("ckp_01_log_until_corrupt", "WITH c AS (SELECT min(event_id) AS cut FROM events WHERE event_id > 500 AND event_id % 97 = 0) SELECT event_id, event_type FROM events, c WHERE event_id < cut")
def ckp_01(spark, sf):
    broken = (F.col("event_id") > 500) & (F.col("event_id") % 97 == 0)
    line = F.when(broken, '{"event_id":').otherwise(F.to_json(F.struct("event_id", "event_type")))
    return tables.read_log(table(spark, sf, "events").select(F.col("event_id").alias("id"), line.alias("line")), "event_id:bigint,event_type:string").drop("id")


@query("ckp_06_stage_metrics", "SELECT event_type AS stage, count(*) AS items, round(sum(value), 4) AS seconds, count(*) FILTER (value > 20) AS passed FROM events GROUP BY event_type")
def ckp_06(spark, sf):
    return tables.stage_metrics(table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"), (F.col("value") > 20).alias("passed")))
