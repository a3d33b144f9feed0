"""Rewards of completions, rubric statistics, model-call costs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL_MARK = "<tool_call>"
#: Weights of correctness, citation precision, citation recall, efficiency, conciseness.
REWARD_WEIGHTS = (1.0, 0.5, 0.5, 0.5, 0.1)


@F.pandas_udf(T.DoubleType())
def character_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of a's characters in matching blocks with b (RWD-01); the block search has no SQL form."""

    def share(x: str | None, y: str | None) -> float:
        if not x:
            return 0.0
        return sum(m.size for m in difflib.SequenceMatcher(None, x, y or "").get_matching_blocks()) / len(x)

    return pd.Series([share(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def overlap_reward(share: Column, max_calls_in_message: Column) -> Column:
    """The overlap if it reaches a quarter, and no message holds four calls or more (RWD-02)."""
    return F.when((max_calls_in_message >= 4) | (share < 0.25), 0.0).otherwise(share)


def call_count(text: Column) -> Column:
    """Occurrences of the tool-call mark (RWD-04)."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(CALL_MARK), F.lit("")))) / len(CALL_MARK)).cast("int")


def answer_block(text: Column) -> Column:
    """What stands in the answer tag, else the whole text, trimmed (RWD-03)."""
    found = F.regexp_extract(text, r"(?is)<answer>(.*?)</answer>", 1)
    return F.trim(F.when(text.rlike(r"(?is)<answer>.*?</answer>"), found).otherwise(text))


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def citations(text: Column) -> Column:
    """Distinct trimmed ids of [Source: ...] marks."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[source:[ \t\r\n]*([^\]]+)\]"), F.lit(1)), lambda c: F.trim(c))
    return F.array_distinct(F.array_remove(found, ""))


def citation_scores(cited: Column, refs: Column) -> tuple[Column, Column]:
    """Precision and recall of cited against reference ids (RWD-05)."""
    shared = F.size(F.array_intersect(cited, refs))
    precision = F.when(F.size(cited) == 0, 0.0).when(F.size(refs) == 0, 1.0).otherwise(shared / F.size(cited))
    recall = F.when((F.size(cited) == 0) | (F.size(refs) == 0), 0.0).otherwise(shared / F.size(refs))
    return precision, recall


def env_citation_scores(cited: Column, refs: Column) -> tuple[Column, Column]:
    """The same as the environment counts it: both noughts where no reference has a file (RWD-07)."""
    precision, recall = citation_scores(cited, refs)
    none = F.size(F.filter(refs, lambda r: F.coalesce(r, F.lit("")) != "")) == 0
    return F.when(none, 0.0).otherwise(precision), F.when(none, 0.0).otherwise(recall)


def efficiency(correct: Column, calls: Column, n_refs: Column, max_calls: int = 10, decay: float = 0.2) -> Column:
    """Correctness, decayed for calls beyond the references and two more (RWD-06)."""
    excess = F.greatest(F.lit(0), calls - (n_refs + 2))
    return F.when((correct <= 0) | (calls > max_calls), 0.0).otherwise(correct * F.exp(-decay * excess))


def reward(correct: Column, precision: Column, recall: Column, efficient: Column, concise: Column) -> Column:
    """Five weighted parts; conciseness counts with a correct answer only (RWD-07)."""
    parts = (correct, precision, recall, efficient, F.when(correct > 0, concise).otherwise(0.0))
    return sum((w * p for w, p in zip(REWARD_WEIGHTS, parts, strict=True)), F.lit(0.0))


def truncated(text: Column, chars: int, mark: str) -> Column:
    """Cut to so many characters with a mark at the end (RWD-10)."""
    return F.when(F.length(text) > chars, F.concat(F.rtrim(F.substring(text, 1, chars - len(mark))), F.lit(mark))).otherwise(text)


def retained_rubrics(scores: DataFrame, k: int = 3, digits: int = 6) -> DataFrame:
    """Rubrics (rubric, polarity, score) whose scores vary, the k most varied of each polarity (RUB-02)."""
    spread = scores.groupBy("rubric", "polarity").agg(F.round(F.stddev_pop("score"), digits).alias("spread")).where("spread > 0")
    w = Window.partitionBy("polarity").orderBy(F.desc("spread"), "rubric")
    return spread.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def adaptive_reward(scores: DataFrame, digits: int = 6) -> DataFrame:
    """(sum of signed scores + negatives) / rubrics, clamped, per response (RUB-03)."""
    sign = F.when(F.col("polarity") == "positive", F.col("score")).otherwise(-F.col("score"))
    out = scores.groupBy("response").agg(F.sum(sign).alias("s"), F.count(F.when(F.col("polarity") != "positive", 1)).alias("n"), F.count("*").alias("k"))
    return out.select("response", F.round(clip01((F.col("s") + F.col("n")) / F.col("k")), digits).alias("reward"))


def static_reward(polarity: Column, score: Column) -> Column:
    """The score, turned for negative rubrics (RUB-04)."""
    return F.when(polarity == "positive", score).otherwise(1 - score)


def slug(title: Column) -> Column:
    """A title as a key."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), F.lit("_"))


def model_costs(usage: DataFrame, prices: DataFrame, digits: int = 6) -> DataFrame:
    """Calls, tokens, latency and cost by model (LLM-03).  prices: a few rows per model and 1000 tokens."""
    cost = F.col("n_in") / 1000 * F.col("price_in") + F.col("n_out") / 1000 * F.col("price_out")
    rows = usage.join(F.broadcast(prices), "model", "left")
    return rows.groupBy("model").agg(
        F.count("*").alias("calls"), F.sum(F.col("n_in") + F.col("n_out")).alias("tokens"), F.round(F.avg("latency"), digits).alias("mean_latency"), F.round(F.sum(cost), digits).alias("cost"),
    )
