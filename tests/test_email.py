import random

from pyspark.sql import functions as F

from loamwork.operators import email as op


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_reply_order_with_forks_orphans_and_cycles(spark):
    rows = [(1, "a", None, "3"), (1, "b", "a", "2"), (1, "c", "a", "1"), (1, "d", "b", "0"), (1, "o", "gone", "1"), (1, "x", "y", "0"), (1, "y", "x", "1")]
    df = spark.createDataFrame(rows, "thread int, id string, parent string, date string")
    got = [r.id for r in op.reply_order(df).orderBy("place").collect()]
    assert got == ["o", "a", "c", "b", "d", "x", "y"]


def test_participant_labels(spark):
    cases = {"  Ann   Lee <ann@x.org>": "Ann Lee", "mailto:Bob.1@x.org": "bob 1 x org", "[[Name A]]": "Name A", " ;,- ": "", "carl [ext]": "carl", "<d.e@f.g>": "d e f g"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", op.participant_label(F.col("v")).alias("x"))
    assert {r.v: r.x for r in df.collect()} == cases


def test_bodies(spark):
    body = "Answer is here, fully.\nmore\n\nOn Tuesday Bob wrote:\n> old"
    assert one(spark, op.unquoted(F.col("b")), b=body) == "Answer is here, fully.\nmore\n"
    assert one(spark, op.without_signature(F.col("b")), b="Text\n--\nAnn") == "Text"
    assert one(spark, op.without_signature(F.col("b")), b="Thanks\n" + "line\n" * 20) == "Thanks\n" + "line\n" * 20
    assert one(spark, op.clean_body(F.col("b")), b="ok\n--\nAnn") == "ok\n--\nAnn"
    assert one(spark, op.clean_body(F.col("b")), b="A longer answer\n--\nAnn") == "A longer answer"


def test_quotes_match_ancestors(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    assert one(spark, op.quote_match(F.col("q"), F.col("a")), q="> " + text, a=text)
    assert not one(spark, op.quote_match(F.col("q"), F.col("a")), q=text, a="something else " * 9)
    assert not one(spark, op.quote_match(F.col("q"), F.col("a")), q="short", a="short")


def test_duplicate_threads_match_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 120))] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "new"]) for b in base[:20]] + [" ".join(base[0])] + ["", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")

    def grams(t):
        w = t.split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])

    reps = {}
    for i, t in enumerate(texts):
        if grams(t):
            reps.setdefault(grams(t), i)
    want = {(a, b) for x, a in reps.items() for y, b in reps.items() if a < b and len(x & y) / len(x | y) >= 0.9}
    got = {(r.a, r.b) for r in op.duplicate_pairs(df).collect()}
    assert got == want and want


def test_automated_mail(spark):
    assert one(spark, op.is_automated(F.col("s"), F.col("t")), s="No-Reply@x.com", t="hi")
    assert one(spark, op.is_automated(F.col("s"), F.col("t")), s="ann@x.org", t="Accepted: lunch")
    assert not one(spark, op.is_automated(F.col("s"), F.col("t")), s="ann@y.org", t="lunch?")


def test_ids_become_unique(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, " ", 2), (1, None, 3)], "thread int, id string, pos int")
    assert [r.id for r in op.unique_ids(df).orderBy("pos").collect()] == ["a", "a__dup_2", "missing_id_2", "missing_id_3"]
