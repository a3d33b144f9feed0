import pytest
from pyspark.sql import functions as F

from loamwork.operators import traces as op

CALLS = "array<struct<name:string,arguments:string>>"


def table(spark, rows):
    return spark.createDataFrame([(*r, []) if len(r) == 4 else r for r in rows], f"trace int, pos int, role string, content string, calls {CALLS}")


def test_windows(spark):
    m = table(spark, [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "tool", "t"), (1, 4, "tool", "t2"), (1, 5, "assistant", "b"), (2, 0, "assistant", "first"), (2, 1, "user", "u"), (2, 2, "assistant", "c")])
    got = [(r.trace, r.turn_index, r.n_prompt, r.n_completion, r.prompt, r.ground_truth) for r in op.examples(m, with_text=True).orderBy("trace", "pos").collect()]
    assert got == [
        (1, 0, 1, 3, "[USER] u", "[ASSISTANT] a\n[TOOL] t\n[TOOL] t2"),
        (1, 1, 4, 1, "[USER] u\n[ASSISTANT] a\n[TOOL] t\n[TOOL] t2", "[ASSISTANT] b"),
        (2, 1, 2, 1, "[ASSISTANT] first\n[USER] u", "[ASSISTANT] c"),
    ]


def test_system_prompts_by_count_then_first_trace(spark):
    m = table(spark, [(1, 0, "system", "b"), (2, 0, "system", "a"), (3, 0, "system", "a"), (3, 1, "system", "b"), (4, 0, "system", "c")])
    assert [(r.prompt, r.n) for r in op.system_prompts(m).orderBy("rank").collect()] == [("a", 2), ("b", 1), ("c", 1)]


def test_kept_and_dropped_partition_the_input(spark):
    m = table(spark, [(i, p, "user" if p % 2 == 0 else "assistant", "x" * (p * 20)) for i in range(5) for p in range(6)])
    rows = op.examples(m).withColumn("reason", op.drop_reason(F.col("content"), F.col("calls"), min_chars=50))
    assert rows.where("reason is null").count() + rows.where("reason is not null").count() == rows.count() == 15


def test_tool_census_keeps_safe_names_and_keys(spark):
    calls = [("get_order", '{"id": "1", "bad-key": "2"}'), ("get_order", "{}"), ("bad name", "{}")]
    m = table(spark, [(1, 0, "assistant", "", calls), (1, 1, "user", "", calls)])
    (r,) = op.tool_census(m).collect()
    assert (r.tool, r.n_calls, r.param_keys, r.sample_args) == ("get_order", 2, "id", '{"id":"1"}')


def test_relay_overlap_is_the_best_earlier_tool_result(spark):
    m = table(spark, [(1, 0, "tool", "alpha beta"), (1, 1, "tool", "gamma delta"), (1, 2, "assistant", "gamma delta beta zeta"), (1, 3, "tool", "zeta"), (2, 0, "assistant", "x")])
    got = {(r.trace, r.pos): r.overlap for r in op.relay_overlap(m).collect()}
    assert got == {(1, 2): 0.5, (2, 0): None}


def test_near_duplicate_pairs_match_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(40)) for _ in range(30)]
    texts += [t[:-1] + "z" for t in texts[:10]] + texts[:4] + ["Mail a@b.c 12", "mail x@y.z 99", "", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    import re

    def grams(t):
        t = re.sub(r"\b[0-9]+\b", "<N>", re.sub(r"\S+@\S+", "<EMAIL>", t[:500].lower()))
        t = re.sub(r"\s+", " ", t).strip()
        return frozenset(t[i : i + 3] for i in range(len(t) - 2))

    reps = {}
    for i, t in enumerate(texts):
        if grams(t):
            reps.setdefault(grams(t), i)
    want = {(a, b) for ga, a in reps.items() for gb, b in reps.items() if a < b and len(ga & gb) / len(ga | gb) > 0.7}
    assert {(r.a, r.b) for r in op.near_duplicate_pairs(df, 0.7).collect()} == want and want


def test_splits_need_enough_rows(spark):
    with pytest.raises(ValueError):
        op.split(spark.range(100), 15, 5, ["id"])
    parts = op.split(spark.range(100), 20, 5, ["id"]).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 20, "eval": 5}


def test_pivot_selection_keeps_anchors(spark):
    rows = spark.range(50).select("id", F.when(F.col("id") < 10, 0.6).when(F.col("id") < 40, 0.1).alias("rating"))
    got = op.select_pivots(rows, "rating", ["id"]).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"pivot": 10, "anchor": 4}


def test_trivial_turns(spark):
    rows = [("Hello there", [], 0, True), ("Hello there", [], 1, False), ("Please provide your order number", [], 3, True), ("", [("get_x", "{}")], 2, True), ("", [("set_x", "{}")], 2, False), ("x" * 60, [("get_x", "{}")], 2, False)]
    df = spark.createDataFrame(rows, f"content string, calls {CALLS}, t int, want boolean")
    assert df.where(op.is_trivial(F.col("content"), F.col("calls"), F.col("t")) != F.col("want")).count() == 0
