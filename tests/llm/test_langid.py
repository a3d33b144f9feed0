import random

import pytest

from loamwork.llm import langid

SYLLABLES = {"aa": ["the", "ing", "er", "an", "wh", "ou"], "bb": ["che", "ung", "keit", "zu", "sch", "ver"], "cc": ["eau", "ment", "oi", "que", "tre", "la"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := rng.choice("abc") * 2, rng.randint(1, 300)), lang) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)


def test_held_out_accuracy(docs):
    import zlib

    model = langid.learn(docs)
    assert set(model.dictionaries) == {"aa", "bb", "cc"}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in langid.predict(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97


def test_the_bound_on_the_sample_holds(docs):
    model = langid.learn(docs, docs_per_language=5, piece_chars=100, dictionary_bytes=300)
    assert all(0 < len(b) <= 300 for b in model.dictionaries.values())


def test_odd_texts(spark, docs):
    model = langid.learn(docs)
    texts = [None, "", " 12 %%", "²", "the", "퟿", "the ing " * 40_000, "keit ungzu 42"]
    rows = spark.createDataFrame([(i, t, "zz", 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, lang_pred string, score double")
    got = [(r.lang_pred, r.rejected) for r in sorted(langid.predict(rows, model).collect())]
    assert got[:4] == [("und", True)] * 4
    assert got[6] == ("aa", False) and got[7] == ("bb", False)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, "a", None), (None, "b", "en"), (3, None, "en")], "doc_id bigint, text string, lang string")
    model = langid.learn(empty)
    assert not model.dictionaries
    assert {r.lang_pred for r in langid.predict(empty, model).collect()} == {"und"}
    assert langid.predict(empty.limit(0), model).count() == 0


def test_a_mixture_is_rejected(docs):
    rng = random.Random(2)
    scorer = langid.Scorer(langid.learn(docs))
    mixed = text(rng, "aa", 150) + " " + text(rng, "bb", 150)
    clean = text(rng, "aa", 300)
    assert scorer.best(clean)[1] > 2 * scorer.best(mixed)[1]


def test_the_number_of_languages_is_bounded(spark, docs):
    stray = docs.union(spark.range(300).selectExpr("id + 1000", "concat('word', id)", "concat('x', id)"))
    assert set(langid.learn(stray, max_languages=3).dictionaries) == {"aa", "bb", "cc"}


def plain_best(text, dictionaries):
    """zstandard called by hand: blocks of 4096 bytes, short ones behind 256 bytes of the dictionary."""
    import re

    import zstandard

    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode()
    sizes = []
    for name, blob in dictionaries.items():
        def size(b, blob=blob):
            own = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return len(zstandard.ZstdCompressor(level=12, dict_data=own, write_content_size=False).compress(b))

        head = blob[:256] + b" "
        blocks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
        sizes.append((sum(size(b) if len(b) >= 512 else size(head + b) - size(head) for b in blocks), name))
    (first, name), (second, _) = sorted(sizes, key=lambda s: s[0])[:2]
    return name, (second - first) / second


def test_predictions_match_compression_by_hand(spark, docs):
    model = langid.learn(docs)
    rng = random.Random(4)
    texts = [text(rng, rng.choice(["aa", "bb", "cc"]), rng.randint(1, 2500)) for _ in range(25)] + [None, "", "7 %", "the"]
    texts += [text(rng, "aa", 200) + " " + text(rng, "bb", 200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in langid.predict(rows, model).collect():
        name, score = plain_best(texts[r.doc_id], model.dictionaries)
        assert (r.lang_pred, r.rejected) == (name, name == "und" or score < 0.01) and abs(r.score - max(0.0, score)) < 1e-12
