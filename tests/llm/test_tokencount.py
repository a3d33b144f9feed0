import random

import pytest

from loamwork.llm import tokencount


@pytest.fixture(scope="module")
def vocabulary():
    return tokencount.Vocabulary()


def plain_count(word, vocabulary):
    """Fewest tokens among the best segmentations, over all cuts of a short word."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            piece = word[start:end]
            if piece in vocabulary.score:
                options.append((best[start][0] + vocabulary.score[piece], -best[start][1] - 1))
            elif len(piece) == 1:
                n = len(piece.encode())
                options.append((best[start][0] + n * vocabulary.byte, -best[start][1] - n))
        top = max(options)
        best[end] = (top[0], -top[1])
    return best[len(word)][1]


def test_counts_match_brute_force(spark, vocabulary):
    rng = random.Random(6)
    syllables = ["the", "ing", "éau", "heit", "ñ", "x", "12", "!!", "日", "\U0001f600"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 50))) for _ in range(60)]
    texts += [None, "", " \n", "a" * 3000, "▁▁ x", "the " * 50_000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int").repartition(2)
    got = {r.doc_id: (r.n_pre_tokens, r.n_tokens) for r in tokencount.token_counts(docs).collect()}
    for i, t in enumerate(texts):
        words = tokencount.pre_tokens(t or "")
        known = {w: plain_count(w, vocabulary) for w in set(words)}
        assert got[i] == (len(words), sum(known[w] for w in words))


def test_prefixes_are_shared_and_the_bound_changes_nothing(vocabulary):
    rng = random.Random(1)
    words = ["▁" + "".join(rng.choice("abe") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    free, tight = tokencount.PreTokenTrie(vocabulary), tokencount.PreTokenTrie(vocabulary, max_nodes=40)
    assert [free.count(w) for w in words] == [tight.count(w) for w in words]
    assert len(free.child) == 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert len(tight.child) < 60


def test_empty_table(spark):
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_long_pre_token_is_scored_alike_without_nodes(vocabulary, monkeypatch):
    rng = random.Random(9)
    words = ["▁" + "".join(rng.choice(["the", "ing", "é", "heit", "ñ", "x", "日", "aa"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    trie = tokencount.PreTokenTrie(vocabulary)
    want = [trie.count(w) for w in words]
    assert want[:5] == [plain_count(w, vocabulary) for w in words[:5]]
    monkeypatch.setattr(tokencount, "LONG_WORD", 0)
    alone = tokencount.PreTokenTrie(vocabulary)
    assert [alone.count(w) for w in words] == want and len(alone.child) == 1


def test_memory_of_a_very_long_pre_token():
    import subprocess
    import sys

    code = """
import resource
from loamwork.llm import tokencount
trie = tokencount.PreTokenTrie(tokencount.Vocabulary())
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert trie.count("QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 80_000) > 100_000
assert len(trie.child) == 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout) < 50
