"""Queries on mail threads as chunks: conversations are threads, turns mails that answer the one before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import threads as op
from .registry import query, table

MAIL = """ml AS (SELECT conv_id AS thread, turn AS pos, conv_id || '.' || turn AS id, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 4 = 0 AND turn > 2 THEN conv_id || '.1' WHEN turn % 5 = 4 THEN 'gone' ELSE conv_id || '.' || (turn - 1) END AS parent,
 CASE WHEN turn % 4 = 3 THEN 'someday' ELSE '2024-0' || (1 + turn % 9) || '-10' END AS date, 'S' || conv_id AS subject, role, text AS body FROM conversations)"""
PATHS = f"""{MAIL}, up(thread, leaf, id, d) AS (SELECT thread, id, id, 0 FROM ml WHERE NOT EXISTS (SELECT 1 FROM ml k WHERE k.thread = ml.thread AND k.parent = ml.id)
 UNION ALL SELECT up.thread, leaf, m.parent, d + 1 FROM up JOIN ml m ON m.thread = up.thread AND m.id = up.id JOIN ml p ON p.thread = m.thread AND p.id = m.parent),
pl AS (SELECT thread, leaf, id, max(d) OVER (PARTITION BY thread, leaf) - d + 1 AS place, first_value(id) OVER (PARTITION BY thread, leaf ORDER BY d DESC) AS root FROM up),
pa AS (SELECT pl.thread, pl.id, place, dense_rank() OVER (PARTITION BY pl.thread ORDER BY root, l.date <> 'someday' DESC, l.date DESC, leaf DESC) - 1 AS path FROM pl JOIN ml l ON l.thread = pl.thread AND l.id = leaf)"""


def mail(spark, sf):
    c = table(spark, sf, "conversations")
    key = lambda t: F.concat_ws(".", F.col("conv_id"), t)
    parent = F.when(F.col("turn") == 0, None).when((F.col("conv_id") % 4 == 0) & (F.col("turn") > 2), key(F.lit("1"))).when(F.col("turn") % 5 == 4, "gone").otherwise(key(F.col("turn") - 1))
    person = lambda name, email: F.struct(name.alias("name"), email.alias("email"))
    boss = F.array(person(F.lit(""), F.lit("boss@x.org")))
    return c.select(
        F.col("conv_id").alias("thread"), F.col("turn").cast("bigint").alias("pos"), key(F.col("turn")).alias("id"), parent.alias("parent"),
        F.when(F.col("turn") % 4 == 3, "someday").otherwise(F.concat(F.lit("2024-0"), (1 + F.col("turn") % 9).cast("string"), F.lit("-10"))).alias("date"),
        F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("subject"), F.col("text").alias("body"),
        person(F.col("role"), F.concat("role", F.lit("@x.org"))).alias("sender"), F.array(person(F.lit("Team"), F.lit("t@x.org"))).alias("to"), F.when(F.col("turn") % 2 == 1, boss).alias("cc"),
    )


@query("eml_25_reply_paths", f"WITH RECURSIVE {PATHS} SELECT pa.thread, path::INT AS path, 'leaf_path' AS kind, place::INT AS place, pos::BIGINT AS pos FROM pa JOIN ml USING (thread, id)")
def eml_25(spark, sf):
    return op.reply_paths(mail(spark, sf), compact=False).select("thread", "path", "kind", "place", "pos")


@query("eml_26_compacted_paths")
def eml_26(spark, sf):
    return op.reply_paths(mail(spark, sf), shared=1, context=1)


BLOCKS = """bl AS (SELECT pa.thread, path, place, pos, date, role, subject, '[msg #' || place || ' | ' || date || ' | ' || role || ' <' || role || '@x.org> -> Team <t@x.org>' || CASE WHEN pos % 2 = 1 THEN ' | cc: boss@x.org' ELSE '' END || ']' || chr(10) AS head,
 regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS body, regexp_replace(substr(body, 1, 2048), '^\\s+', '') || ' [truncated]' AS short FROM pa JOIN ml USING (thread, id)),
ln AS (SELECT *, length(head) + length(body) AS n, length(head) + length(short) AS m FROM bl), su AS (SELECT *, sum(n + 2) OVER (PARTITION BY thread, path ORDER BY place) AS s, count(*) OVER (PARTITION BY thread, path) AS mails FROM ln),
en AS (SELECT a.thread, a.path, a.place AS start, any_value(a.mails) AS mails, max(b.place) AS stop FROM su a JOIN su b ON a.thread = b.thread AND a.path = b.path AND b.place >= a.place AND b.place < a.place + 10
 AND (b.place = a.place OR CASE WHEN a.n > 2048 THEN a.m ELSE a.n END + 2 + b.s - a.s <= 2048) GROUP BY 1, 2, 3),
wr(thread, path, start, last) AS (SELECT DISTINCT thread, path, 1, 0 FROM pa UNION ALL SELECT wr.thread, wr.path, CASE WHEN stop <= last THEN last + 1 ELSE wr.start + greatest(1, stop - wr.start - 1) END, greatest(last, stop) FROM wr JOIN en ON wr.thread = en.thread AND wr.path = en.path AND wr.start = en.start WHERE stop < mails),
wi AS (SELECT wr.thread, wr.path, row_number() OVER (PARTITION BY wr.thread, wr.path ORDER BY wr.start) - 1 AS win, wr.start, stop FROM wr JOIN en ON wr.thread = en.thread AND wr.path = en.path AND wr.start = en.start WHERE stop > last)"""


@query("eml_27_windows", f"WITH RECURSIVE {PATHS}, {BLOCKS} SELECT thread, path::INT AS path, win::INT AS \"window\", start::INT AS first, stop::INT AS last FROM wi")
def eml_27(spark, sf):
    return op.windows(op.path_blocks(mail(spark, sf)))


@query("eml_28_thread_chunks", f"""WITH RECURSIVE {PATHS}, {BLOCKS}, ow AS (SELECT wi.thread, wi.path, win, start, stop, place, pos, date, role, subject, head || CASE WHEN place = start AND n > 2048 THEN short ELSE body END AS text FROM wi JOIN ln ON wi.thread = ln.thread AND wi.path = ln.path AND place BETWEEN start AND stop),
pe AS (SELECT thread, path, win, who, min(seat) AS seat FROM (SELECT thread, path, win, role AS who, place * 10 AS seat FROM ow UNION ALL SELECT thread, path, win, 'Team', place * 10 + 1 FROM ow UNION ALL SELECT thread, path, win, 'boss x org', place * 10 + 2 FROM ow WHERE pos % 2 = 1) GROUP BY ALL),
pn AS (SELECT thread, path, win, list(who ORDER BY seat) AS w FROM pe GROUP BY ALL),
tx AS (SELECT thread, path, win, any_value(subject) AS subject, max(date) FILTER (place = start) AS d0, max(date) FILTER (place = stop) AS d1, string_agg(text, chr(10) || chr(10) ORDER BY place) AS t FROM ow GROUP BY ALL),
ot AS (SELECT *, max(win) OVER (PARTITION BY thread, path) AS last, count(*) OVER (PARTITION BY thread, path) AS k FROM tx JOIN pn USING (thread, path, win)), ct AS (SELECT thread, path, count(*) AS mails FROM pa GROUP BY ALL)
SELECT thread, (row_number() OVER (PARTITION BY thread ORDER BY path, win) - 1)::INT AS idx, thread || '-' || path || '-' || (win + 1) AS chunk_id, CASE WHEN win > 0 THEN thread || '-' || path || '-' || win ELSE '' END AS parent_chunk_id,
 CASE WHEN win < last THEN thread || '-' || path || '-' || (win + 2) ELSE '' END AS child, array_to_string(list_transform(w, lambda x: lower(x)), ';') AS participants, mails AS thread_message_count,
 md5('Subject: ' || subject || chr(10) || 'Date: ' || d0 || ' to ' || d1 || chr(10) || 'Participants: ' || array_to_string(list_slice(w, 1, 3), ', ') || CASE WHEN len(w) > 3 THEN ' (+' || (len(w) - 3) || ' more)' ELSE '' END || chr(10) || chr(10) || t) AS content FROM ot JOIN ct USING (thread, path)""")
def eml_28(spark, sf):
    rows = op.thread_chunks(mail(spark, sf))
    return rows.select("thread", "idx", "chunk_id", "parent_chunk_id", F.array_join("child_chunk_ids", ";").alias("child"), F.array_join("participants", ";").alias("participants"), "thread_message_count", F.md5("content").alias("content"))


@query("eml_29_date_keys", """WITH d AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-28' WHEN 2 THEN '2024-02-28T10:00Z' WHEN 3 THEN ' soon ' WHEN 4 THEN '2024-12-01 23:59:59+02:00' END AS date FROM events)
SELECT event_id, (event_id % 6 IN (1, 2, 4))::INT AS parsed, CASE event_id % 6 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-28T00:00:00' WHEN 2 THEN '2024-02-28T10:00:00+00:00' WHEN 3 THEN 'soon' WHEN 4 THEN '2024-12-01T23:59:59+02:00' ELSE '' END AS text FROM d""")
def eml_29(spark, sf):
    date = F.expr("CASE event_id % 6 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-28' WHEN 2 THEN '2024-02-28T10:00Z' WHEN 3 THEN ' soon ' WHEN 4 THEN '2024-12-01 23:59:59+02:00' END")
    return table(spark, sf, "events").select("event_id", op.date_key(date, F.lit("")).alias("k")).select("event_id", "k.parsed", "k.text")
