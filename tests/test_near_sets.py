"""Texts near by their trigrams, found by codes in blocks and tiles."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamwork.functions import nearsets
from loamwork.operators import traces as op


def texts_of(n, seed):
    """Texts of a few common words, some of them one or many changes away from an earlier one."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.2:
            text = list(rng.choice(out))
            for _ in range(rng.choice([1, 2, 4, 9])):
                text[rng.randrange(len(text))] = rng.choice("aeioulnrst ")
            out.append("".join(text))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(4, 60))))
    return out


def brute(texts, threshold):
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    grams = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(grams)), np.float32)
    for i, s in enumerate(sets):
        held[i, [grams[g] for g in s]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    a, b = np.nonzero(np.triu(both / (size[:, None] + size - both) > threshold, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


def test_tiles_lose_no_pair_and_few_others_meet():
    texts = list(dict.fromkeys(texts_of(1800, 1)))
    n = [len(nearsets.trigrams(t)) for t in texts]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "n": pa.array(n, pa.int32()), "block": pa.array([i % 2 for i in range(len(texts))], pa.int32()), "x": texts})
    rows = pa.Table.from_batches(nearsets._Codes(texts[:16])(iter([batch])))
    want, met = brute(texts, 0.8), set()
    for p, kept in ((0, [0]), (1, [0, 1]), (3, [1])):
        own = rows.filter(pa.compute.is_in(rows["block"], pa.array(kept, pa.int32())))
        found = nearsets._Near(0.8, 2)(own.append_column("p", pa.array([p] * own.num_rows, pa.int64())))
        met |= {(min(x), max(x)) for x in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)}
    assert want and want <= met and len(met) < 3 * len(want)


def test_blocks_give_the_pairs_of_brute_force_by_one_row_per_set(spark):
    texts = list(dict.fromkeys(texts_of(400, 2)))
    df = spark.createDataFrame([*enumerate(texts), (900, texts[0]), (None, texts[1]), (901, None), (902, "ab")], "id long, content string")
    found = nearsets.classes(nearsets.trigram_sets(df, F.col("content")))
    for blocks in (1, 3):
        got = [(r.a, r.b) for r in nearsets.near_sets(found, 0.8, blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(texts, 0.8)
    plan = op.near_duplicate_pairs(df)._jdf.queryExecution().toString()
    assert "grams" not in plan  # no row per text and trigram


def test_no_pairs_of_no_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "id string, content string")
    assert op.near_duplicate_pairs(df).collect() == []
    got = {(r.id, r.leader, r.kept) for r in op.capped_clusters(df, keep=2).collect()}
    assert got == {("1", "1", True), ("2", "1", True), ("3", "1", False)}
    assert op.near_duplicate_pairs(df.where("id = '9'")).count() == 0


def test_sets_under_one_id_stay_apart(spark):
    a, b = "the quick brown fox jumps over the lazy dog and runs", "a wholly different line of words that stands alone here"
    df = spark.createDataFrame([(5, a), (5, b), (9, a + "s"), (9, b + "s")], "id int, content string")
    assert [(r.a, r.b) for r in op.near_duplicate_pairs(df, 0.8).collect()] == [(5, 9), (5, 9)]


def test_clusters_of_near_texts_are_those_of_one_pass(spark):
    texts = texts_of(250, 3)
    texts += texts[:20]
    near, leader = brute(texts, 0.8), {}
    for b in range(len(texts)):
        leader[b] = min((a for a in range(b) if leader[a] == a and (a, b) in near), default=b)
    seen, want = {}, set()
    for i in range(len(texts)):
        seen[leader[i]] = seen.get(leader[i], 0) + 1
        want.add((i, leader[i], seen[leader[i]] <= 2))
    found = op.capped_clusters(spark.createDataFrame(list(enumerate(texts)), "id int, content string"), 2, 0.8)
    assert {tuple(r) for r in found.collect()} == want and len({x[1] for x in want}) < len(texts) - 20
    assert "grams" not in found._jdf.queryExecution().toString()  # whole sets are not shuffled
