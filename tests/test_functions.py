import random
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamwork.functions import sampling, sets, text


def test_exclusive_quantiles_match_the_standard_library(spark):
    rng = random.Random(1)
    for n in (2, 3, 8, 51):
        values = [rng.randint(0, 20) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v int")
        want = statistics.quantiles(values, n=4)
        for p, w in zip((0.25, 0.5, 0.75), want, strict=True):
            r = sampling.exclusive_quantile(df, "v", p).first()
            assert abs(r.lo + r.w * (r.hi - r.lo) - w) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0, 10), max_size=6), st.integers(0, 50))
def test_apportionment_sums_to_the_total(weights, total):
    got = sampling.apportion(weights, total)
    assert sum(got.values()) == (total if sum(weights.values()) > 0 and total > 0 else 0)
    assert set(got) == set(weights)


def test_set_helpers(spark):
    row = spark.createDataFrame([("the cat sat", "the cat ran", "")], "a string, b string, e string").select(
        sets.jaccard(sets.char_ngrams(F.col("a"), 3), sets.char_ngrams(F.col("b"), 3)).alias("j"),
        sets.jaccard(sets.char_ngrams(F.col("e"), 3), sets.char_ngrams(F.col("e"), 3), 1.0).alias("both"),
        F.size(sets.word_ngrams(text.words(F.col("e")), 2)).alias("none"),
        sets.containment(text.blank_split(F.col("a")), text.blank_split(F.col("b"))).alias("c"),
    ).first()
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    a, b = grams("the cat sat"), grams("the cat ran")
    assert abs(row.j - len(a & b) / len(a | b)) < 1e-12 and row.both == 1.0 and row.none == 0 and abs(row.c - 2 / 3) < 1e-12


def test_words_are_unicode(spark):
    row = spark.createDataFrame([("Été_1, naïve x-ray 日本",)], "t string").select(text.words(F.col("t")).alias("w"), text.words(F.col("t"), 3).alias("l")).first()
    assert row.w == ["été_1", "naïve", "x", "ray", "日本"] and row.l == ["été_1", "naïve", "ray"]
