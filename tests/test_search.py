import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamwork.operators import predicates as pred
from loamwork.operators import search as op


def test_parse_drops_malformed_nodes():
    assert pred.parse({"and": [{"field": "a", "op": "eq", "value": 1}, {"x": 1}, {"or": []}]}) == pred.And((pred.Field("a", "eq", 1),))
    assert pred.parse({"not": {"field": " ", "op": "eq"}}) is None and pred.parse(5) is None


def test_required_operators_and_problems():
    tree = pred.parse({"and": [{"field": "a", "op": "eq", "value": 1}, {"not": {"or": [{"field": "b", "op": "near", "value": 1}]}}]})
    assert pred.required_operators(tree) == ({"eq", "near"}, {"and", "or", "not"})
    assert pred.problems(tree, logic=("and", "not")) == ["unsupported operator or", "unsupported operator near"]


def test_negation_gives_the_same_rows(spark):
    df = spark.range(40).select("id", (F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("b"))
    tree = pred.Not(pred.Or((pred.Field("a", "gte", 3), pred.Not(pred.And((pred.Field("b", "eq", 1), pred.Field("a", "lte", 1)))))))
    assert not any(isinstance(n, pred.Not) and not isinstance(n.clause, pred.Field) for n in pred.walk(pred.negated(tree)))
    rows = lambda t: sorted(r.id for r in df.where(pred.compile(t)).collect())
    assert rows(tree) == rows(pred.negated(tree)) == [i for i in range(40) if i % 5 <= 1 and i % 3 == 1]


def test_unknown_operator():
    with pytest.raises(ValueError):
        pred.compile(pred.Field("a", "near", 1))


def test_spec_problems():
    assert pred.spec_problems("lexical", 5, "x") == []
    assert len(pred.spec_problems("hybrid", 0)) == 3 and pred.spec_problems("other", True)


def test_bm25_matches_a_plain_version(spark):
    docs = ["the cat sat on the mat", "the dog", "cat cat dog", "bird"]
    query = "cat dog zebra"
    got = {r.id: r.score for r in op.bm25(spark.createDataFrame(list(enumerate(docs)), "id int, text string"), spark.createDataFrame([(1, query)], "qid int, text string")).collect()}
    split = [d.split() for d in docs]
    avg = sum(map(len, split)) / len(docs)
    want = {}
    for i, w in enumerate(split):
        s = 0.0
        for t in set(query.split()):
            tf, df = Counter(w)[t], sum(t in x for x in split)
            if tf:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        if s:
            want[i] = round(s, 6)
    assert got == want


def test_fusion_ranks(spark):
    one = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid int, id int, rank int")
    two = spark.createDataFrame([(1, 8, 1)], "qid int, id int, rank int")
    got = [(r.id, r.score) for r in op.fuse([(one, 1.0), (two, 0.5)], 5).orderBy("rank").collect()]
    assert got == [(8, round(1 / 62 + 0.5 / 61, 9)), (7, round(1 / 61, 9))]
    assert op.fuse([(one, 1.0)], 5, rank_base=0).orderBy("rank").first().score == round(1 / 60, 9)


def test_related_skips_self_and_neighbours(spark):
    chunks = spark.createDataFrame([(i, "f" if i < 5 else "g", i % 5) for i in range(8)], "id int, file string, idx int")
    hits = spark.createDataFrame([(0, q, i, 1.0 + i) for q in (1, 2) for i in (0, 1, 3, 6)] + [(0, 1, 7, 9.0)], "qid int, query int, id int, score double")
    got = [(r.id, r.n_queries) for r in op.related(hits, chunks, spark.createDataFrame([(0, 0)], "qid int, pid int"), 5).orderBy("rank").collect()]
    assert got == [(6, 2), (3, 2), (7, 1)]


def test_rewrite(spark):
    rows = {
        'How do I use "Fast  Path" in the API site:docs.x.org?': 'site:docs.x.org "Fast Path" API',
        "what is the": "what is the",
        "  ": "",
        "Redis redis AND cache b 7": "Redis AND cache 7",
    }
    df = spark.createDataFrame([(k,) for k in rows], "q string").select("q", op.rewrite(F.col("q")).alias("r"))
    assert {r.q: r.r for r in df.collect()} == rows
    long = spark.createDataFrame([(" ".join(f"word{i:03d}" for i in range(40)),)], "q string").select(op.rewrite(F.col("q"), max_terms=40).alias("r")).first().r
    assert len(long) <= 140 and not long.endswith(" ") and long.split()[-1].startswith("word") and len(long.split()[-1]) == 7


def test_best_mode():
    assert op.best_mode({"lexical", "vector"}) == "vector"
    with pytest.raises(ValueError):
        op.best_mode(set())
