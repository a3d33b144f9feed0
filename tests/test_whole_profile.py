import random

from loamwork.operators import profile as op
from loamwork.plans import profile


def test_every_word_of_the_band_is_an_entity(spark, tmp_path):
    rng = random.Random(6)
    pool = [f"word{j:02d}x" for j in range(70)]
    texts = [" ".join(rng.sample(pool, 12)) for _ in range(100)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    df = {w: sum(w in t for t in texts) for w in pool}
    want = {w: n for w, n in df.items() if 2 <= n < 40}
    assert len(want) > 40
    assert {r.name for r in profile.entities(spark, str(tmp_path)).collect()} == set(want)
    assert {r.name: r.n_chunks for r in profile.prf_10(spark, str(tmp_path)).collect()} == want


def test_names_inside_words_and_of_several_words(spark):
    texts = {1: "A Party, partly; art", 2: "New  York\nnew york", 3: "c++ NEW YORKER", 4: "none", 5: None}
    chunks = spark.createDataFrame(list(texts.items()), "id int, text string")
    names = ["Art", "new york", "c++", "party", "_"]
    got = sorted((r.name, r.id) for r in op.entity_edges(chunks, spark.createDataFrame([(n,) for n in names], "name string")).collect())
    assert got == sorted((n, i) for i, t in texts.items() for n in names if t and n.lower() in t.lower())
