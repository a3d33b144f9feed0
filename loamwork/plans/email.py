"""Queries on mail: conversations as threads, turns as mails that answer the one before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.greedy import components
from ..operators import email as op
from .registry import query, table

MAIL = """ml AS (SELECT conv_id AS thread, turn AS pos, conv_id || '.' || turn AS id, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 4 = 0 AND turn > 2 THEN conv_id || '.1' WHEN turn % 5 = 4 THEN 'gone' ELSE conv_id || '.' || (turn - 1) END AS parent, role AS sender, text AS body, 'd' || (9 - turn % 3) AS date FROM conversations)"""


def mail(spark, sf):
    c = table(spark, sf, "conversations")
    key = lambda t: F.concat_ws(".", F.col("conv_id"), t)
    parent = F.when(F.col("turn") == 0, None).when((F.col("conv_id") % 4 == 0) & (F.col("turn") > 2), key(F.lit("1"))).when(F.col("turn") % 5 == 4, "gone").otherwise(key(F.col("turn") - 1))
    return c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("pos"), key(F.col("turn")).alias("id"), parent.alias("parent"), F.col("role").alias("sender"), F.col("text").alias("body"), F.concat(F.lit("d"), (9 - F.col("turn") % 3).cast("string")).alias("date"))


@query("eml_02_body_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br[ \t\r\n]*/?>', chr(10), 'gi'), '</p[ \t\r\n]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '[ \t\r\n\x0b\x0c]+', ' ', 'g'))) AS body FROM pages")
def eml_02(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(op.body_text(F.col("html"))).alias("body"))


@query("eml_03_thread_ids", r"""SELECT doc_id, 'thread_' || substr(sha1(coalesce(CASE WHEN doc_id % 4 = 0 THEN 'ref' || source END, CASE WHEN doc_id % 4 = 1 THEN 'rep' || lang END, nullif(trim(regexp_replace(lower(CASE WHEN doc_id % 4 = 2 THEN 'Re: ' || substr(text, 1, 12) ELSE '' END), '^(re|fw|fwd)[ \t]*:[ \t]*', '')), ''), doc_id::VARCHAR)), 1, 16) AS thread_id FROM documents""")
def eml_03(spark, sf):
    k = F.col("doc_id") % 4
    refs = F.when(k == 0, F.array(F.concat(F.lit("ref"), "source"))).otherwise(F.array().cast("array<string>"))
    subject = F.when(k == 2, F.concat(F.lit("Re: "), F.substring("text", 1, 12))).otherwise("")
    reply = F.when(k == 1, F.concat(F.lit("rep"), "lang")).otherwise("")
    return table(spark, sf, "documents").select("doc_id", op.thread_id(refs, reply, subject, F.col("doc_id").cast("string")).alias("thread_id"))


@query("eml_04_schema_warnings", "WITH w AS (SELECT doc_id AS id, unnest([CASE WHEN doc_id % 7 = 0 THEN 'date' END, CASE WHEN doc_id % 11 = 0 THEN 'subject' END]) AS field FROM documents) SELECT id, field FROM w WHERE field IS NOT NULL ORDER BY id, field LIMIT 200")
def eml_04(spark, sf):
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(i.alias("id"), F.col("source").alias("thread_id"), F.when(i % 7 == 0, " ").otherwise("x").alias("date"), F.when(i % 11 != 0, "x").alias("subject"), F.lit("b").alias("body"))
    return op.warnings(rows)


@query("eml_05_participant_labels", """SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'bob 1 x org' WHEN 2 THEN 'Name A' WHEN 3 THEN '' WHEN 4 THEN 'carl' ELSE 'Dee' END || '' AS label FROM benchmark""")
def eml_05(spark, sf):
    raw = F.expr("CASE item_id % 6 WHEN 0 THEN '  Ann   Lee <ann@x.org>' WHEN 1 THEN 'mailto:Bob.1@x.org' WHEN 2 THEN '[[Name A]]' WHEN 3 THEN ' ;,- ' WHEN 4 THEN 'carl [ext]' ELSE '- Dee,' END")
    return table(spark, sf, "benchmark").select("item_id", op.participant_label(raw).alias("label"))


@query("eml_06_participants", f"""WITH {MAIL}, p AS (SELECT id, unnest([sender, upper(sender), 'team', 'x' || (pos % 2)]) AS p, unnest([0, 1, 2, 3]) AS pos FROM ml), o AS (SELECT id, lower(p) AS k, min_by(p, pos) AS p, min(pos) AS pos FROM p GROUP BY 1, 2) SELECT id, string_agg(p, '; ' ORDER BY pos) AS participants FROM o GROUP BY id""")
def eml_06(spark, sf):
    people = F.array(F.col("sender"), F.upper("sender"), F.lit("team"), F.concat(F.lit("x"), (F.col("pos") % 2).cast("string")))
    return op.participants(mail(spark, sf).withColumn("people", people))


@query("eml_07_reply_order", f"""WITH RECURSIVE {MAIL}, k AS (SELECT *, lpad(row_number() OVER (PARTITION BY thread ORDER BY date, id)::VARCHAR, 6, '0') AS key FROM ml),
t(thread, id, path, depth) AS (SELECT thread, id, key, 0 FROM k WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM k p WHERE p.thread = k.thread AND p.id = k.parent) UNION ALL SELECT k.thread, k.id, t.path || '/' || k.key, depth + 1 FROM t JOIN k ON k.thread = t.thread AND k.parent = t.id)
SELECT thread, id, depth::INT AS depth, row_number() OVER (PARTITION BY thread ORDER BY path)::INT AS place FROM t""")
def eml_07(spark, sf):
    return op.reply_order(mail(spark, sf)).select("thread", "id", "depth", "place")


@query("eml_08_thread_documents", f"WITH {MAIL}, g AS (SELECT thread, count(*) AS n_mails, string_agg(DISTINCT lower(sender), ',' ORDER BY lower(sender)) AS people, string_agg(body, chr(10) ORDER BY pos) AS text FROM ml GROUP BY thread) SELECT thread, n_mails, people, sha1(people || chr(10) || text) AS signature FROM g")
def eml_08(spark, sf):
    return op.thread_documents(mail(spark, sf)).drop("text")


SH = r"""sw AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n\x0b\x0c]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT id, list_distinct(list_transform(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END, lambda g: ('0x' || substr(sha1(g), 1, 15))::BIGINT)) AS s FROM sw)"""


@query("eml_09_shingles", f"WITH {SH} SELECT id, len(s)::INT AS n, list_min(s) AS low FROM sh")
def eml_09(spark, sf):
    s = op.shingles(F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), s.alias("s")).select("id", F.size("s").alias("n"), F.array_min("s").alias("low"))


def _band_sql(bands: int, rows: int) -> str:
    c = op.coefficients(bands * rows)
    key = lambda b: f"'{b}-' || " + " || '-' || ".join(f"list_min(list_transform(x, lambda s: (s * {a} + {d}) % {op.PRIME}))" for a, d in c[b * rows : (b + 1) * rows])
    return "[" + ", ".join(key(b) for b in range(bands)) + "]"


@query("eml_10_minhash_bands", f"WITH {SH}, x AS (SELECT id, list_transform(s, lambda v: v % {op.PRIME}) AS x FROM sh WHERE len(s) > 0) SELECT id, md5(array_to_string({_band_sql(9, 3)}, ',')) AS keys FROM x")
def eml_10(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), op.shingles(F.col("text")).alias("s")).where(F.size("s") > 0)
    return op.minhash(rows).select("id", F.md5(F.array_join("keys", ",")).alias("keys"))


@query("eml_12_duplicate_pairs", f"""WITH {SH}, c AS (SELECT min(id) AS id, s FROM (SELECT id, list_sort(s) AS s FROM sh WHERE len(s) > 0) GROUP BY s), x AS (SELECT id, len(s) AS n, unnest(s) AS v FROM c)
SELECT a.id AS a, b.id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS similarity FROM x a JOIN x b ON a.v = b.v AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 0.9 * (any_value(a.n) + any_value(b.n) - count(*))""")
def eml_12(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return op.duplicate_pairs(texts).withColumn("similarity", F.round("similarity", 6))


BODIES = "bo AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN substr(text, 1, 60) || chr(10) || 'On Monday X wrote:' || chr(10) || substr(text, 1, 90) WHEN 1 THEN substr(text, 1, 50) || chr(10) || '--' || chr(10) || 'Ann' WHEN 2 THEN 'From: x' || chr(10) || text WHEN 3 THEN substr(text, 1, 40) || chr(10) || 'Best regards,' || chr(10) || 'Bob' ELSE substr(text, 1, 100) END AS body FROM documents)"


def bodies(spark, sf):
    body = F.expr(r"CASE doc_id % 5 WHEN 0 THEN concat(substr(text, 1, 60), '\nOn Monday X wrote:\n', substr(text, 1, 90)) WHEN 1 THEN concat(substr(text, 1, 50), '\n--\nAnn') WHEN 2 THEN concat('From: x\n', text) WHEN 3 THEN concat(substr(text, 1, 40), '\nBest regards,\nBob') ELSE substr(text, 1, 100) END")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), body.alias("body"))


@query("eml_17_quote_lines", f"WITH {BODIES}, l AS (SELECT id, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS i FROM bo) SELECT b.id, m.i::INT AS start FROM bo b LEFT JOIN (SELECT id, min(i) AS i FROM l WHERE regexp_matches(x, '{op.alternation(op.QUOTE_LINES)}') GROUP BY id) m ON b.id = m.id")
def eml_17(spark, sf):
    return bodies(spark, sf).select("id", op.quote_start(F.col("body")).alias("start"))


@query("eml_20_signatures", f"""WITH {BODIES}, l AS (SELECT id, string_split(body, chr(10)) AS ls FROM bo), m AS (SELECT id, ls, list_min(list_filter(list_transform(ls, lambda x, i: CASE WHEN i - 1 >= len(ls) - 12 AND regexp_matches(x, '{op.alternation(op.SIGNATURE_LINES)}') THEN i - 1 END), lambda y: y IS NOT NULL)) AS k FROM l)
SELECT id, md5(CASE WHEN k IS NULL THEN array_to_string(ls, chr(10)) ELSE array_to_string(list_slice(ls, 1, k), chr(10)) END) AS body FROM m""")
def eml_20(spark, sf):
    return bodies(spark, sf).select("id", F.md5(op.without_signature(F.col("body"))).alias("body"))


@query("eml_21_clean_bodies", f"""WITH {BODIES}, l AS (SELECT id, body, string_split(body, chr(10)) AS ls FROM bo), q AS (SELECT *, list_min(list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '{op.alternation(op.QUOTE_LINES)}') THEN i - 1 END), lambda y: y IS NOT NULL)) AS k FROM l),
c AS (SELECT id, body, CASE WHEN k IS NULL THEN ls ELSE list_slice(ls, 1, k) END AS ls FROM q), m AS (SELECT *, list_min(list_filter(list_transform(ls, lambda x, i: CASE WHEN i - 1 >= len(ls) - 12 AND regexp_matches(x, '{op.alternation(op.SIGNATURE_LINES)}') THEN i - 1 END), lambda y: y IS NOT NULL)) AS k FROM c),
o AS (SELECT id, body, trim(coalesce(array_to_string(CASE WHEN k IS NULL THEN ls ELSE list_slice(ls, 1, k) END, chr(10)), '')) AS kept FROM m) SELECT id, length(CASE WHEN length(trim(regexp_replace(lower(kept), '[^a-z0-9]+', ' ', 'g'))) < 8 THEN body ELSE kept END)::INT AS n_chars FROM o""")
def eml_21(spark, sf):
    return bodies(spark, sf).select("id", F.length(op.clean_body(F.col("body"))).alias("n_chars"))


SUBJECTS = "sj AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'no-reply@a.com' WHEN 1 THEN 'ann@github.com' WHEN 2 THEN 'bo@y.org' ELSE lang || '@z.net' END AS sender, CASE doc_id % 7 WHEN 0 THEN 'Accepted: lunch' WHEN 1 THEN 'your receipt for order 5' WHEN 2 THEN 'Build failed' ELSE substr(text, 1, 30) END AS subject FROM documents)"


@query("eml_22_automated_mail", f"WITH {SUBJECTS} SELECT id, regexp_matches(sender, '{op.alternation(op.AUTOMATED_SENDERS)}') OR regexp_matches(subject, '{op.alternation(op.AUTOMATED_SUBJECTS)}') AS automated FROM sj")
def eml_22(spark, sf):
    sender = F.expr("CASE doc_id % 6 WHEN 0 THEN 'no-reply@a.com' WHEN 1 THEN 'ann@github.com' WHEN 2 THEN 'bo@y.org' ELSE concat(lang, '@z.net') END")
    subject = F.expr("CASE doc_id % 7 WHEN 0 THEN 'Accepted: lunch' WHEN 1 THEN 'your receipt for order 5' WHEN 2 THEN 'Build failed' ELSE substr(text, 1, 30) END")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), op.is_automated(sender, subject).alias("automated"))


@query("eml_30_addresses", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'N <' || source || '@x.org>' WHEN 1 THEN 'N' WHEN 2 THEN source || '@x.org' ELSE 'unknown' END AS address FROM documents")
def eml_30(spark, sf):
    k = F.col("doc_id") % 4
    return table(spark, sf, "documents").select("doc_id", op.address(F.when(k < 2, F.lit(" N ")), F.when(k % 2 == 0, F.concat("source", F.lit("@x.org")))).alias("address"))


@query("eml_33_unique_ids", """WITH m AS (SELECT conv_id AS thread, turn AS pos, CASE WHEN turn % 4 = 3 THEN ' ' ELSE 'm' || (turn % 2) END AS id FROM conversations), b AS (SELECT *, CASE WHEN trim(id) = '' THEN 'missing_id_' || pos ELSE id END AS base FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY thread, base ORDER BY pos) AS k FROM b) SELECT thread, pos, CASE WHEN k > 1 THEN base || '__dup_' || k ELSE base END AS id FROM k""")
def eml_33(spark, sf):
    c = table(spark, sf, "conversations")
    mid = F.when(F.col("turn") % 4 == 3, " ").otherwise(F.concat(F.lit("m"), (F.col("turn") % 2).cast("string")))
    return op.unique_ids(c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("pos"), mid.alias("id")))


@query("eml_35_match_text", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS text FROM documents")
def eml_35(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(op.match_text(F.col("text"))).alias("text"))


@query("eml_13_merge_guards", "SELECT doc_id, (doc_id % 11) / 10 > 0.9 AND (doc_id % 7) / 6 > 0.9 AND (doc_id % 5) / 4 > 0.9 AS mergeable FROM documents")
def eml_13(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", op.mergeable(i % 11 / 10, i % 7 / 6, i % 5 / 4).alias("mergeable"))


COMPONENTS = f"""{SH}, sk AS (SELECT id, list_sort(s) AS s FROM sh WHERE len(s) > 0), cl AS (SELECT min(id) AS id, s FROM sk GROUP BY s), x AS (SELECT id, len(s) AS n, unnest(s) AS v FROM cl),
pr AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.v = b.v AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 0.9 * (any_value(a.n) + any_value(b.n) - count(*)) UNION SELECT cl.id, sk.id FROM sk JOIN cl ON sk.s = cl.s AND cl.id < sk.id),
e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), re(a, b) AS (SELECT a, a FROM e UNION SELECT re.a, e.b FROM re JOIN e ON re.b = e.a), ro AS (SELECT a AS id, min(b) AS root FROM re GROUP BY a)"""


@query("eml_14_collapse", f"""WITH RECURSIVE {COMPONENTS}, t AS (SELECT doc_id AS id, n_chars, doc_id % 5 AS n_mails, coalesce(root, doc_id) AS root FROM documents LEFT JOIN ro ON doc_id = id)
SELECT id, root, row_number() OVER (PARTITION BY root ORDER BY n_chars DESC, n_mails DESC, id) = 1 AS kept FROM t""")
def eml_14(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars", (F.col("doc_id") % 5).alias("n_mails"))
    return op.collapse(d.drop("text"), op.duplicate_links(d.select("id", "text")))


@query("eml_16_dedupe_report", f"WITH RECURSIVE {COMPONENTS} SELECT CASE WHEN n > 1 THEN 'clustered' ELSE 'single' END AS kind, count(*) AS groups, sum(n)::BIGINT AS threads, sum(n - 1)::BIGINT AS dropped FROM (SELECT count(*) AS n FROM documents LEFT JOIN ro ON doc_id = id GROUP BY coalesce(root, doc_id)) GROUP BY 1")
def eml_16(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    roots = texts.select("id").join(components(op.duplicate_links(texts)), "id", "left")
    sizes = roots.groupBy(F.coalesce("root", "id").alias("root")).agg(F.count("*").alias("n"))
    return sizes.groupBy(F.when(F.col("n") > 1, "clustered").otherwise("single").alias("kind")).agg(F.count("*").alias("groups"), F.sum("n").alias("threads"), F.sum(F.col("n") - 1).alias("dropped"))


@query("eml_18_ancestors", f"""WITH RECURSIVE {MAIL}, l AS (SELECT c.thread, c.id, c.parent FROM ml c JOIN ml p ON c.thread = p.thread AND c.parent = p.id),
t(thread, id, ancestor, depth) AS (SELECT thread, id, parent, 1 FROM l UNION ALL SELECT t.thread, t.id, l.parent, depth + 1 FROM t JOIN l ON t.thread = l.thread AND t.ancestor = l.id) SELECT thread, id, ancestor, depth::INT AS depth FROM t""")
def eml_18(spark, sf):
    return op.ancestors(mail(spark, sf))
