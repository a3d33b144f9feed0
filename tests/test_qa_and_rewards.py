import math

from pyspark.sql import functions as F

from loamwork.functions.sampling import apportion
from loamwork.operators import linking, qa
from loamwork.operators import rewards as rw


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_guards_in_order(spark):
    lit = F.lit
    long = "x" * 60
    g = lambda q, a=long, n=1, s="natural", o=0.0, **k: value(spark, qa.guard_reason(lit(q), lit(a), lit(n), lit(s), lit(o), **k))
    good = "A question that is fine?"
    assert g(good) is None and g("short") == "question_too_short" and g(good, s="odd") == "invalid_style"
    assert g(good, "x" * 20) == "answer_too_short" and g(good, n=0) == "no_references" and g(good, o=0.75) == "redundant_chunks"
    assert g("Cannot generate a question") == "meta_question" and g(good, language="korean") == "wrong_language"
    assert g("질문이 여기에 있습니다 그래요", "답" * 20, language="korean") is None


def test_gate(spark):
    g = lambda q, a="An answer that is long enough to be of some real use to whoever asked this.": value(spark, qa.gate_reason(F.lit(q), F.lit(a)))
    assert g("widget and gadget") == "fragment" and g("posthog cli ci api key") is None
    assert g("What are the main sections of this?") == "structural"
    assert g("Where can I find the docs for this?") == "guide_pointer" and g("Where can I find the docs for this?", "Go to Settings and then choose one of the many entries that are listed in the menu.") is None
    assert g("How do I configure the thing that I was talking about?", "No idea.") == "thin_answer"


def test_styles(spark):
    s = lambda q: value(spark, qa.style(F.lit(q)))
    assert s("") == "keyword" and s("redis ttl config") == "keyword" and s("How to set it") == "natural" and s("Redis TTL") == "natural"
    assert s("troubleshoot timeout error") == "expert" and s("redis vs memcached for this app") == "expert"


def test_composite_ignores_missing_scores(spark):
    none = F.lit(None).cast("double")
    assert value(spark, qa.composite(none, none, none)) is None
    assert math.isclose(value(spark, qa.composite(F.lit(1.0), none, F.lit(0.5))), (0.4 + 0.15) / 0.7)


def test_quotas_are_never_exceeded(spark):
    rows = spark.range(60).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("type"), (F.col("id") % 7).cast("double").alias("score"))
    got = qa.accept(rows, spark.createDataFrame([("a", 5)], "type string, quota int")).where("accepted").collect()
    assert len(got) == 5 and {r.type for r in got} == {"a"} and min(r.score for r in got) >= 5


def test_apportioned_agrees_with_the_driver_version(spark):
    weights = {"a": 3.0, "b": 1.0, "c": 1.0, "d": 0.0}
    df = spark.createDataFrame(list(weights.items()), "key string, weight double")
    for total in (1, 7, 10):
        assert {r.key: r.n for r in qa.apportioned(df, total).collect()} == apportion(weights, total)


def test_stratified_split_keeps_both_sides(spark):
    df = spark.range(12).select("id", F.when(F.col("id") < 2, "x").when(F.col("id") < 3, "y").otherwise("z").alias("k"))
    got = {(r["k"], r["part"]): r["count"] for r in qa.stratified_split(df, ["k"], 0.9).groupBy("k", "part").count().collect()}
    assert got == {("x", "train"): 1, ("x", "eval"): 1, ("y", "eval"): 1, ("z", "train"): 8, ("z", "eval"): 1}


def test_near_questions(spark):
    a = spark.createDataFrame([(1, "how do i set the cache size now"), (2, "other words here"), (3, "one")], "id int, question string")
    b = spark.createDataFrame([(9, "How do I set the cache size"), (8, "one")], "id int, question string")
    assert [(r.id, round(r.similarity, 3)) for r in qa.near_questions(a, b).collect()] == [(1, round(6 / 7, 3))]


def test_early_stop(spark):
    df = spark.createDataFrame([(1, 10, 5), (2, 10, 1), (3, 10, 0), (4, 10, 1), (5, 10, 9)], "batch int, generated int, accepted int")
    assert [r.stop for r in qa.early_stop(df).orderBy("batch").collect()] == [False, False, False, True, False]


def test_reward_parts(spark):
    assert value(spark, rw.call_count(F.lit("<tool_call>a<tool_call>b"))) == 2
    assert value(spark, rw.answer_block(F.lit("x <Answer> yes </answer>"))) == "yes" and value(spark, rw.answer_block(F.lit(" plain "))) == "plain"
    p, r = rw.citation_scores(rw.citations(F.lit("[Source: a] [source:b ] [Source: a]")), F.array(F.lit("a"), F.lit("c")))
    assert (value(spark, p), value(spark, r)) == (0.5, 0.5)
    e = lambda c, n, k: value(spark, rw.efficiency(F.lit(c), F.lit(n), F.lit(k)))
    assert e(0.0, 1, 1) == 0 and e(1.0, 11, 9) == 0 and e(0.5, 3, 1) == 0.5 and math.isclose(e(1.0, 5, 1), math.exp(-0.4))
    assert value(spark, rw.overlap_reward(F.lit(0.25), F.lit(3))) == 0.25 and value(spark, rw.overlap_reward(F.lit(0.9), F.lit(4))) == 0


def test_rubrics(spark):
    df = spark.createDataFrame([("a", "positive", 0.0), ("a", "positive", 1.0), ("b", "positive", 1.0), ("b", "positive", 1.0)], "rubric string, polarity string, score double")
    assert [(r.rubric, r.spread) for r in rw.retained_rubrics(df).collect()] == [("a", 0.5)]
    s = spark.createDataFrame([(1, "positive", 1.0), (1, "negative", 1.0), (2, "negative", 0.0)], "response int, polarity string, score double")
    assert {r.response: r.reward for r in rw.adaptive_reward(s).collect()} == {1: 0.5, 2: 1.0}


def test_greedy_diversity_matches_a_plain_fold(spark):
    texts = ["a b c d", "a b c e", "x y z", "a b c d", "q r s"]
    rows = spark.createDataFrame([(1, i, t, i + 1) for i, t in enumerate(texts)], "pid int, id int, text string, rank int")
    assert [r.id for r in linking.diverse(rows).orderBy("place").collect()] == [0, 2, 4]


def test_rated_pivots_try_again(spark):
    from loamwork.operators import models

    seen = []

    def ask(prompt):
        seen.append(prompt)
        if prompt == "never" or seen.count(prompt) < 3:
            raise TimeoutError
        return '{"importance_score": 0.75, "category": "trivial"}'

    rows = spark.createDataFrame([(1, "late"), (2, "never"), (3, None)], "id int, prompt string").coalesce(1)
    got = {r.id: (r.score, r.category) for r in models.rated_pivots(rows, "prompt", ask).collect()}
    assert got == {1: (0.75, "trivial"), 2: (0.5, "downstream"), 3: (0.5, "downstream")}
