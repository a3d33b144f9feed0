from collections import Counter

from loamwork.operators import linking as op
from loamwork.plans import linking


def _documents(spark, path, n=120):
    words = [f"common{j}" for j in range(60)]
    rows = [(i, f"s{i % 3}", " ".join([f"own{i}x{j}" for j in range(30)] + words[i % 7 : i % 7 + 40]), "en", 500) for i in range(n)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string, lang string, n_chars bigint").repartition(2).write.parquet(f"{path}/documents.parquet")
    return rows


def test_every_document_is_a_candidate(spark, tmp_path):
    rows = _documents(spark, str(tmp_path))
    got = {(r.pid, r.id): r.score for r in linking.lnk_03(spark, str(tmp_path)).collect()}
    assert got == {(p, i): (i * 7 + p * 3) % 97 / 10 for p in range(3) for i, source, *_ in rows if source != f"s{p}" and i % 10 != 3}
    near = linking.lnk_04(spark, str(tmp_path)).count()
    assert near == linking.lnk_05(spark, str(tmp_path)).count() == linking.lnk_08(spark, str(tmp_path)).count() == len(got)
    assert {r.pid: r.confidence for r in linking.lnk_17(spark, str(tmp_path)).collect()} == {p: min(1.0, n / 40) for p, n in Counter(p for p, _ in got).items()}


def test_every_document_has_graph_scores(spark, tmp_path):
    n = 80
    rows = [(i, "s", f"alpha{i % 5} beta{i % 4}", "en", 1) for i in range(n)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.pid, r.id): (r.shared, r.new) for r in linking.lnk_11(spark, str(tmp_path)).collect()}
    held = {i: {f"alpha{i % 5}": 0.5, f"beta{i % 4}": 0.8} for i in range(n)}
    for x in held:
        held[x] = {w: 0.5 if len(w) % 2 == 0 else 0.8 for w in held[x]}
    want = {}
    for a, x in held.items():
        for b, y in held.items():
            if a != b and set(x) & set(y):
                s = sum(x[w] for w in set(x) & set(y))
                want[a, b] = (round(s / len(x), 9), round((sum(y.values()) - s) / len(y), 9))
    assert got == want and max(a for a, _ in got) == n - 1


def test_the_pick_goes_on_past_copies(spark):
    texts = ["a b c d"] * 30 + [f"a b c d e{i % 2}" for i in range(45)] + ["x y z", "", "q r s"]
    rows = spark.createDataFrame([(p, i, t, i + 1) for p in (1, 2) for i, t in enumerate(texts[: 76 + p])], "pid int, id int, text string, rank int")
    got = {p: [r.id for r in op.diverse(rows.where(f"pid = {p}")).orderBy("place").collect()] for p in (1, 2)}
    assert got == {1: [0, 75, 76], 2: [0, 75, 76]}
    near = spark.createDataFrame([(1, i, f"a b c d e f g h i{i}", i + 1) for i in range(50)] + [(1, 50, "x", 51), (1, 51, "y", 52)], "pid int, id int, text string, rank int")
    assert [r.id for r in op.diverse(near).orderBy("place").collect()] == [0, 50, 51]
    assert op.diverse(near.limit(0)).count() == 0
