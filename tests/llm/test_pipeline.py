import random
import re
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from loamwork.llm import langid, packing, simhash  # noqa: E402

SYLLABLES = {"aa": ["the", "ing", "er", "an", "wh", "ou"], "bb": ["che", "ung", "keit", "zu", "sch", "ver"]}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for i in range(160):
        lang = rng.choice(["aa", "bb"])
        t = text(rng, lang, rng.randint(30, 200)) + (f" mail x{i}.y@z.org, 10.0.0.{i}." if i % 4 == 0 else "")
        rows.append((i, t, lang, f"s{i % 3}", len(t)))
    rows += [(200 + k, rows[k][1], "aa", "s0", None) for k in range(30)]
    rows += [(300, None, None, None, None), (301, "12 %", "aa", "s1", 4), (302, "", "aa", None, 0), (5, *rows[5][1:]), (None, rows[7][1], "aa", "s1", 1)]
    rows += [(None, t := text(rng, "bb", 90), "bb", "s1", len(t))] * 2
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = corpus_pipeline.materialise(stages["language_id"](spark, docs, folder), "kept")
    scorer = langid.Scorer(langid.learn(docs))
    want = [r for r in docs.collect() if scorer.best(r.text)[0] != "und" and scorer.best(r.text)[1] >= 0.01]
    assert Counter(kept.collect()) == Counter(want) and len(want) > 170

    single = corpus_pipeline.materialise(stages["simhash_near_dedup"](spark, kept, folder), "single")
    rows, prints = single.collect(), [simhash.fingerprint_of(r.text, 3) for r in kept.collect()]
    assert single.columns == docs.columns
    assert set(rows) <= set(kept.collect()) and len({r.doc_id for r in rows if r.doc_id is not None}) == sum(r.doc_id is not None for r in rows)
    groups: list[set] = []
    for r, p in zip(kept.collect(), prints, strict=True):
        near = [g for g in groups if any((p ^ q).bit_count() <= 3 for q, _ in g)]
        groups = [g for g in groups if g not in near] + [set().union({(p, r.doc_id)}, *near)]
    assert len(rows) == len(groups)
    assert {r.doc_id for r in rows} == {min((i for _, i in g if i is not None), default=None) for g in groups}

    private = corpus_pipeline.materialise(stages["pii_pseudonyms"](spark, single, folder), "private")
    by = {r.doc_id: r for r in private.collect()}
    for r in rows:
        found = re.findall(r"x\d+\.y@z\.org|10\.0\.0\.\d+", r.text)
        assert all(f not in by[r.doc_id].text for f in found)
        if not found:
            assert by[r.doc_id].text == r.text
        assert by[r.doc_id].n_chars == len(by[r.doc_id].text)

    mixed = corpus_pipeline.materialise(stages["source_mixing"](spark, private, folder), "mixed")
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(private.collect())

    packed = stages["packing"](spark, mixed, folder).collect()
    encoder = packing.ByteBpe("byte_bpe_50k.json", None)
    want = Counter()
    for r in mixed.collect():
        want[(r.doc_id, np.array([*encoder.encode(r.text), 1], "<u4").tobytes())] += 1
    total = Counter()
    for p in packed:
        total[p.doc_id] += p.length
    assert total == Counter({i: sum(len(b) // 4 * n for (j, b), n in want.items() if j == i) for i in {j for j, _ in want}})


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_that_share_an_id_are_kept_apart(spark):
    rng = random.Random(3)
    a, b, c = (text(rng, "aa", 80) for _ in range(3))
    rows = [(3, a, "aa", "s", 1), (5, a, "aa", "s", 1), (5, b, "aa", "s", 1), (7, b, "aa", "s", 1), (None, c, "aa", "s", 1), (None, None, None, None, None), (9, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for some in (docs, docs.union(docs)):
        got = corpus_pipeline.drop_near_duplicates(spark, some, "").collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(3, a), (5, b), (0, c), (9, "")])
