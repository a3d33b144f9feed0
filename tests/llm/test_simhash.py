import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loamwork.llm import simhash
from loamwork.llm.graph import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes):
            out |= 1 << bit
    return out


def plain_components(prints, budget=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [t.replace("w3 ", "w4 ", 1) for t in texts[:30]] + texts[:10] + [None, "", "   ", "One", "ONE  two"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = plain_components(prints)
    assert {i: got[i].fingerprint for i in got} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {i: got[i].component_id for i in got} == dict(enumerate(want))
    assert len({r.component_key for r in got.values()}) == len(set(want))


def test_links_are_whole_when_nodes_are_opened(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {int(b) for b in base} | {0}
    for b in base[:3]:
        for _ in range(150):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    want = plain_components(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for leaf_rows in (5, 40, 10_000):
        roots = {r.vertex: r.root for r in connected_components(simhash.fingerprint_links(df, 3, leaf_rows)).collect()}
        groups = {}
        for i, x in enumerate(signed):
            groups.setdefault(roots.get(x, x), set()).add(i)
        expect = {}
        for i, w in enumerate(want):
            expect.setdefault(w, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_empty_table_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "x y z"), (7, "x y z"), (9, "x y z"), (None, "x y z")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 7), (7, 7), (7, 7), (9, 7)]


def test_a_text_longer_than_a_chunk():
    text = " ".join(f"t{i % 997}" for i in range(70_000))
    assert simhash.fingerprint_of(text, 3) == plain_fingerprint(text)


def test_components_of_long_chains(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    edges = edges.union(spark.createDataFrame([(100, 101), (101, 100), (5, 5)], "a bigint, b bigint"))
    got = {r.vertex: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


def test_traversal_alone_finds_every_link():
    """Trie pairs are opened down to single keys, from the root or from any block, and prune by the budget."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    keys = set(base.tolist())
    for x in base[:20].tolist():
        for _ in range(12):
            y = x
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(bit)
            keys.add(y)
    keys = np.array(sorted(keys), dtype=np.uint64)
    for budget in (0, 1, 3, 9):
        visits = []
        label = simhash.trie_join(keys, np.array([[0, len(keys), 0, len(keys), 0, 0]]), budget, visits)
        want = plain_components(keys.tolist(), budget)
        assert label.tolist() == want and sum(visits) > len(keys) - 1
    pruned, whole = [], []
    root = np.array([[0, len(keys), 0, len(keys), 0, 0]])
    simhash.trie_join(keys, root, 3, pruned)
    simhash.trie_join(keys, root, 64, whole)
    assert sum(pruned) < sum(whole)


def test_the_traversal_runs_on_whole_tables():
    """Fingerprints of a table: blocks with several keys are opened further, and links come from there."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    keys = np.array(sorted({simhash.fingerprint_of(t, 3) for t in texts}), dtype=np.uint64)
    top = keys >> np.uint64(48)
    start = np.concatenate(([0], np.flatnonzero(top[1:] != top[:-1]) + 1))
    end = np.append(start[1:], len(keys))
    pairs = np.stack([start, end, start, end, np.full(len(start), 16), np.zeros(len(start))], axis=1).astype(np.int64)
    visits = []
    label = simhash.trie_join(keys, pairs, 3, visits)
    assert sum(visits) > 0
    want = np.arange(len(keys))
    for s, e in zip(start, end):
        want[s:e] = s + np.array(plain_components(keys[s:e].tolist()))
    assert label.tolist() == want.tolist()


def test_equal_keys_and_nodes_at_full_depth():
    keys = np.array([5, 5, 5, 9, 9], dtype=np.uint64)
    assert simhash.trie_join(keys, np.array([[0, 5, 0, 5, 0, 0]]), 0).tolist() == [0, 0, 0, 3, 3]
