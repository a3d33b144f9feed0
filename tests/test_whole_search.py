import numpy as np

from loamwork.plans import search


def _embeddings(spark, path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], int(i % 5)) for i in range(60)]
    rows[7], rows[40] = (7, [0.0] * 4, 2), (40, [0.0] * 4, -3)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return rows


def _best(rows, k, score):
    want = {}
    for q in rows:
        if q[0] % 20:  # the query set: every row whose id is divisible by 20
            continue
        found = sorted(((score(q, x), x[0]) for x in rows), key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))[:k]
        want |= {(q[0], n): (i, s) for n, (s, i) in enumerate(found, 1)}
    return want


def test_every_twentieth_row_asks_all(spark, tmp_path):
    rows = _embeddings(spark, str(tmp_path))

    def cosine(q, x):
        a, b = np.array(q[1]), np.array(x[1])
        return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6) if (a @ a) * (b @ b) else None

    got = {(r.qid, r["rank"]): (r.id, r.score) for r in search.srh_02(spark, str(tmp_path)).collect()}
    assert got == _best(rows, 10, cosine) and len(got) == 30


def test_the_label_lists_of_the_query_set(spark, tmp_path):
    rows = _embeddings(spark, str(tmp_path))
    got = {(r.qid, r["rank"]): (r.id, r.score) for r in search.label_list(spark, str(tmp_path), 20).collect()}
    assert got == _best(rows, 20, lambda q, x: -abs(q[2] - x[2]))
    for fused in (search.srh_04, search.srh_05, search.srh_06, search.srh_07):
        assert fused(spark, str(tmp_path)).select("qid").distinct().count() == 3


def test_bm25_by_blocks_is_as_row_by_row(spark):
    import math
    import random
    import re

    from loamwork.operators.search import bm25

    rng = random.Random(4)
    texts = [" ".join(f"w{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(rng.randint(0, 30))) for _ in range(150)]
    rows = [*enumerate(texts), (3, texts[3]), (5, "w1 w1 w2"), (None, "w1 w2"), (None, "w2 w1"), (900, None), (901, texts[8]), (902, texts[8])]
    asked = [(q, " ".join(f"W{rng.randint(0, 45)}" for _ in range(rng.randint(0, 6)))) for q in range(40)] + [(1, "w1 w1"), (50, None)]
    split = lambda t: re.findall(r"\w+", t.lower())
    lens = [len(split(t)) for _, t in rows if t is not None]
    tf = {}
    for i, t in rows:
        for w in split(t or ""):
            tf[w, i, len(split(t))] = tf.get((w, i, len(split(t))), 0) + 1
    want = {}
    for q, t in {(q, w) for q, t in asked for w in split(t or "")}:
        held = [(i, n, c) for (w, i, n), c in tf.items() if w == t]
        idf = math.log(1 + (len(rows) - len(held) + 0.5) / (len(held) + 0.5))
        for i, n, c in held:
            want.setdefault(q, {})[i] = want.get(q, {}).get(i, 0) + idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n * len(lens) / sum(lens)))
    best = {(q, n): (i, round(s, 6)) for q, found in want.items() for n, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0] is not None, x[0]))[:7], 1)}
    corpus = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    got = bm25(corpus, spark.createDataFrame(asked, "qid int, text string"), 7, most=40, asked=9)
    assert {(r.qid, r["rank"]): (r.id, r.score) for r in got.collect()} == best
    assert bm25(corpus, spark.createDataFrame([(1, "zz")], "qid int, text string")).count() == bm25(corpus.limit(0), spark.createDataFrame(asked, "qid int, text string")).count() == 0
