"""Queries against their SQL where the engines' case rules and word boundaries differ."""

import __spark_entry__ as entry
import duckdb
from pyspark.sql import functions as F

from loamwork.functions import text


def compared(spark, folder, name, documents):
    """The query's and the SQL's rows over a table of documents (doc_id, text, source)."""
    rows = [(i, t, "en", s, len(t)) for i, t, s in documents]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder)).collect()
    return sorted(map(tuple, got), key=str), sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)


def test_upper_and_lower_by_character(spark):
    letters = "".join(chr(c) for c in range(0xC0, 0x590)) + "ᾀῳﬁŉẞ"
    row = spark.range(1).select(text.upper_each(F.lit("große " + letters)).alias("u"), text.lower_each(F.lit("ΛΟΣ İx")).alias("l")).first()
    assert row.u.startswith("GROẞE ") and len(row.u) == len(letters) + 6 and row.u.endswith("ᾈῼﬁŉẞ") and row.l == "λοσ ix"


def test_entity_patterns_with_sharp_s(spark, tmp_path):
    documents = [(i, f"other{i} große" if i < 3 else f"other{i} things", "src1") for i in range(10)]
    got, want = compared(spark, tmp_path, "prf_03_entity_patterns", documents)
    assert got == want and ("GROẞE", "entity") in got


def test_quality_gate_at_letters_with_accents(spark, tmp_path):
    documents = [(38, "éget? It is a text that is long enough to be an answer to what was asked, or so it seems.", "a"), (46, "widgetx or none", "a")]
    got, want = compared(spark, tmp_path, "qaf_11_quality_gate", documents)
    assert got == want and got[0] == (38, None)


def test_filter_chain_at_letters_with_accents(spark, tmp_path):
    documents = [(38, "éget? It is a text that is long enough to be an answer to what was asked, or so it seems.", "a"), (70, "écannot create. It is a text that is long enough to be an answer to what was asked, or so it seems.", "a")]
    got, want = compared(spark, tmp_path, "qaf_20_filter_chain", documents)
    assert got == want and got[0] == (38, None)


def test_filter_chain_at_wide_spaces_and_repeated_ids(spark, tmp_path):
    long = "It is a text that is long enough to be an answer to what was asked, or so it seems."
    documents = [(6, "\u00a0" * 30, "a"), (7, "\u3000 ab \u2003" + "\u00a0" * 9, "a"), (10, "\u0130" * 11 + "\u00a0\u03a3", "a"), (14, long, "a"), (14, "short", "a"), (None, long, "a"), (30, long[:40] + "\t" * 20, "a")]
    got, want = compared(spark, tmp_path, "qaf_20_filter_chain", documents)
    assert got == want and len(got) == 8 and (7, "guards:question_too_short") in got
