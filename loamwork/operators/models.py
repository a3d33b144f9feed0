"""Model calls as an injected function: batched, in parallel within a task, null where a call fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call(rows: DataFrame, prompt: str, ask: Callable[[str], str], *, parallel: int = 8, output: str = "response") -> DataFrame:
    """Ask a model for every row (LLM-01); the answer stands beside its row, null if the call fails.

    Calls cost money and Spark may run a task again: write the result to a table
    before anything else reads it.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        def safe(p: str | None) -> str | None:
            try:
                return None if p is None else ask(p)
            except Exception:  # a failed call is a null answer
                return None

        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                yield batch.assign(**{output: list(pool.map(safe, batch[prompt]))})

    return rows.mapInPandas(run, schema)


def without_fences(text: Column) -> Column:
    """An answer without think blocks and code fences."""
    text = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    inner = F.regexp_extract(text, r"(?s)```(?:json)?[ \t]*\n?(.*?)```", 1)
    return F.trim(F.when(text.rlike(r"(?s)```.*?```"), inner).otherwise(text))


def parse_qa(text: Column) -> Column:
    """struct(question, answer) of an answer in JSON, in Q:/A: lines, or in two lines or more; nulls if it cannot be read (QAF-07)."""
    plain = without_fences(text)
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bare = (F.size(lines) >= 2) & ~plain.startswith("{")
    body = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    q = F.coalesce(F.nullif(F.get_json_object(body, "$.question"), F.lit("")), F.nullif(F.regexp_extract(plain, r"(?is)(?:question|q)[ \t]*:[ \t]*([^\n]+)", 1), F.lit("")))
    a = F.coalesce(F.nullif(F.get_json_object(body, "$.answer"), F.lit("")), F.nullif(F.regexp_extract(plain, r"(?is)(?:answer|a)[ \t]*:[ \t]*(.+)$", 1), F.lit("")))
    refused = plain.rlike(r"(?i)cannot[_ ]generate")
    none = q.isNull() & a.isNull() & bare
    rest = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")
    return F.struct(F.when(~refused, F.when(none, F.get(lines, F.lit(0))).otherwise(q)).alias("question"), F.when(~refused, F.when(none, rest).otherwise(a)).alias("answer"))


def judge_flags(text: Column) -> Column:
    """struct(answerable, confidence, reason) of a judge's JSON; not answerable and 0 if it cannot be read (QAF-41)."""
    body = F.regexp_extract(without_fences(text), r"(?s)(\{.*\})", 1)
    yes = F.lower(F.coalesce(F.get_json_object(body, "$.answerable"), F.lit("false"))) == "true"
    sure = F.coalesce(F.expr("0.0D") + F.get_json_object(body, "$.confidence").try_cast("double"), F.lit(0.0))
    return F.struct(yes.alias("answerable"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), F.get_json_object(body, "$.reason").alias("reason"))


def pivot_rating(text: Column) -> Column:
    """struct(score, category) of a rating's JSON: clamped, unknown categories and unreadable answers downstream (TRC-22)."""
    body = F.regexp_extract(without_fences(text), r"(?s)(\{.*\})", 1)
    score = F.get_json_object(body, "$.importance_score").try_cast("double")
    kind = F.get_json_object(body, "$.category")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.5))))
    return F.struct(clamped.alias("score"), F.when(kind.isin("pivot", "downstream", "trivial"), kind).otherwise("downstream").alias("category"))


def rated_pivots(rows: DataFrame, prompt: str, ask: Callable[[str], str], tries: int = 5) -> DataFrame:
    """Rows with a model's rating of their turn: ..., score, category (TRC-22).

    A call is tried again as often as given; one that fails for good, or whose
    answer cannot be read, rates 0.5 and downstream.
    """

    def patient(p: str) -> str:
        for n in range(tries):
            try:
                return ask(p)
            except Exception:
                if n + 1 == tries:
                    raise
        raise AssertionError

    asked = call(rows, prompt, patient).withColumn("rating", pivot_rating(F.coalesce("response", F.lit(""))))
    return asked.select(*rows.columns, "rating.score", "rating.category")
