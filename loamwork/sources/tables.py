"""Reads and writes of table-shaped stores, and the state of runs that go on where they stopped."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trace_count(spans: DataFrame) -> DataFrame:
    """One row: distinct traces (SRC-11).  spans: trace; null traces do not count."""
    return spans.agg(F.count_distinct("trace").alias("n"))


def newest(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """The newest id of each name by the order's columns, ties by id (SRC-14).  rows: id and these."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.max_by("id", F.struct(*order, "id")).alias("id"))


def upsert_rows(chunks: DataFrame, chars: int = 4000) -> DataFrame:
    """Chunks as a vector store takes them: id, content (cut), file_path, chunk_index, char_count, content_hash (SRC-15).

    chunks: id, text, file, idx.  The count and the hash are those of the whole
    text; a null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    return chunks.select("id", F.substring(text, 1, chars).alias("content"), F.col("file").alias("file_path"), F.col("idx").alias("chunk_index"), F.length(text).alias("char_count"), F.md5(text).alias("content_hash"))


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with rows in place of those of the same key (SRC-15): an anti join, no duplicate keys from rows."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def page(rows: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """The next rows after a key, in its order (SRC-16): a filter that reaches the scan, and a top-n."""
    return rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def lookup(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is wanted, once each whatever the repeats in wanted (SRC-17).  wanted: the key."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def resume_state(log: DataFrame) -> DataFrame:
    """Per kind: entries, the last id, bad ones (CKP-03).  log: kind, id, bad."""
    return log.groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("last_id"), F.count_if("bad").alias("n_bad"))


def usable(log: DataFrame, config: str, wanted: str) -> DataFrame:
    """The log if its configuration's hash is the one wanted, else none of it (CKP-03)."""
    return log if config == wanted else log.limit(0)


def until_corrupt(log: DataFrame) -> DataFrame:
    """The entries before the first corrupt one (CKP-01).  log: id (its order), bad, ...; the minimum is one row."""
    first = log.where("bad").agg(F.min("id").alias("__cut"))
    return log.join(F.broadcast(first)).where(F.coalesce(F.col("id") < F.col("__cut"), F.lit(True))).drop("__cut")


def read_log(lines: DataFrame, schema: str) -> DataFrame:
    """Entries of an append log before its first line that is no JSON (CKP-01).  lines: id, line."""
    kinds = f"struct<{schema}>"
    rows = lines.select("id", F.from_json("line", kinds).alias("e"), F.try_parse_json("line").isNull().alias("bad"))
    return until_corrupt(rows).select("id", "e.*")


def stage_metrics(log: DataFrame, digits: int = 4) -> DataFrame:
    """Per stage: items, seconds, passed, summed over the runs (CKP-06).  log: stage, seconds, passed."""
    return log.groupBy("stage").agg(F.count("*").alias("items"), F.round(F.sum("seconds"), digits).alias("seconds"), F.count_if("passed").alias("passed"))


def config_hash(**config: object) -> str:
    """16 hex digits that change with the configuration and not with the order of its keys (CKP-02).

    Distributions are mappings of texts to floats.
    """
    plain = {k: {str(a): float(b) for a, b in v.items()} if isinstance(v, dict) else v for k, v in config.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:16]


def json_safe(value: object) -> object:
    """A value with what JSON cannot hold as null, and without members whose keys are no texts or numbers (CKP-04)."""
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, dict):
        return {k: json_safe(v) for k, v in value.items() if isinstance(k, str | int)}
    return [json_safe(v) for v in value] if isinstance(value, list | tuple) else None


#: Members of a stored row beside those of the question.
META, HISTORY, EVENTS, VERDICT = "__generation_metadata", "__regeneration_history", "__journey_events", "__filter_verdict"


def stored(qa: Column, metadata: Column, history: Column, events: Column, verdict: Column) -> Column:
    """A question with its state as a JSON line; without a verdict that member is missing (CKP-04)."""
    fields = F.struct(qa.alias("qa"), metadata.alias(META), history.alias(HISTORY), events.alias(EVENTS), verdict.alias(VERDICT))
    return F.to_json(fields)


def restored(line: Column, qa: str, metadata: str, events: str) -> Column:
    """The parts of a stored line by their schemas; missing lists are empty (CKP-04)."""
    verdict = "struct<status:string,reason:string,reasoning:string,metadata:map<string,string>>"
    read = F.from_json(line, f"struct<qa:{qa},{META}:{metadata},{HISTORY}:array<string>,{EVENTS}:array<{events}>,{VERDICT}:{verdict}>")
    return F.struct(read["qa"].alias("qa"), read[META].alias("metadata"), F.coalesce(read[HISTORY], F.array().cast("array<string>")).alias("history"), F.coalesce(read[EVENTS], F.array().cast(f"array<{events}>")).alias("events"), read[VERDICT].alias("verdict"))


#: A trace as a record: its messages, scores and metadata.
RECORD = (
    "struct<id:string,messages:array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string,id:string>>,tool_call_id:string,name:string>>,"
    "scores:map<string,double>,metadata:map<string,string>,timestamp:string,errors:array<string>>"
)


def to_record(trace: Column) -> Column:
    """A trace as JSON; a missing time and an empty list of errors have no member (TRC-28)."""
    return F.to_json(trace.withField("errors", F.when(F.size(trace["errors"]) > 0, trace["errors"])))


def from_record(line: Column) -> Column:
    """A trace read back: missing messages, scores and metadata are empty, contents too, calls have arguments (TRC-28)."""
    r = F.from_json(line, RECORD)
    call = lambda c: F.struct(F.coalesce(c["name"], F.lit("")).alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments"), c["id"].alias("id"))
    calls = lambda m: F.when(F.size(m["tool_calls"]) > 0, F.transform(m["tool_calls"], call))
    message = lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), calls(m).alias("tool_calls"), m["tool_call_id"].alias("tool_call_id"), m["name"].alias("name"))
    none = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string,id:string>>,tool_call_id:string,name:string>>"
    return F.struct(
        r["id"].alias("id"), F.coalesce(F.transform(r["messages"], message), F.array().cast(none)).alias("messages"), F.coalesce(r["scores"], F.create_map().cast("map<string,double>")).alias("scores"),
        F.coalesce(r["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"), r["timestamp"].alias("timestamp"), r["errors"].alias("errors"),
    )


def positions(chunks: DataFrame, file: str, key: str) -> DataFrame:
    """Chunks with their place, from 0, in their file (CHK-14)."""
    return chunks.withColumn("pos", F.row_number().over(Window.partitionBy(file).orderBy(key)) - 1)


def by_hash(chunks: DataFrame) -> DataFrame:
    """The last chunk of each content: hash, id (CHK-11).  chunks: id, content."""
    return chunks.groupBy(F.md5("content").alias("hash")).agg(F.max("id").alias("id"))


def of_length(chunks: DataFrame, least: int, most: int) -> DataFrame:
    """Chunks whose text has so many characters (CHK-12); null texts have none."""
    return chunks.where(F.length("text").between(least, most))
