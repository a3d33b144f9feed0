import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm import repetition


def plain_repeats(ids):
    n, out = len(ids), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and ids[i + k] == ids[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_longest_repeats(ids):
    want = plain_repeats(ids)
    assert repetition.longest_repeats(np.array(ids, dtype=np.int64)).tolist() == want
    assert repetition.longest_repeats(np.array(ids, dtype=np.int64), 0).tolist() == want


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_figures_match_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", "  \n ", "a\na\n\na", "é x y\x0bz"]
    for _ in range(80):
        pool = ["de", "la#", "é|", "x", "ok%"][: rng.randint(1, 5)] + [f"u{k}" for k in range(rng.randint(0, 60))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(rng.choice(pool) for _ in range(rng.randint(0, 150))))
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id bigint, text string, kept boolean").repartition(2)
    for r in repetition.judge(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        repeats = plain_repeats(words)
        inside = {i + k for i, n in enumerate(repeats) if n >= 5 for k in range(n)}
        assert tuple(r)[1:6] == plain(texts[r.doc_id])
        assert r.longest_repeat == max(repeats, default=0)
        assert abs(r.covered - len(inside) / max(1, len(words))) < 1e-12
        base = len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)
        assert r.base_failed == base and r.kept == (not base and r.covered <= 0.3 and r.longest_repeat <= 64)


def test_chunks_do_not_matter(monkeypatch):
    texts = ["a b c a b c d " * 5, "a b c " * 3, "x", None, "a b c d e f " * 9]
    whole = repetition.measure_all(texts, 5, 3)
    monkeypatch.setattr(repetition, "CHUNK_WORDS", 10)
    assert whole.equals(repetition.measure_all(texts, 5, 3))


def test_spans_are_maximal():
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 8, 2, 3])
    repeats = repetition.longest_repeats(ids)
    assert repetition.maximal_spans(repeats, 2) == [(0, 3), (4, 7), (8, 10)]


def test_very_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "der " * 300_000), (2, " ".join(f"w{i}" for i in range(200_000)))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in repetition.judge(docs).collect()}
    assert got[1].longest_repeat == 299_999 and got[1].base_failed and not got[1].kept
    assert got[2].longest_repeat == 0 and got[2].kept
    assert repetition.judge(docs.limit(0)).count() == 0


def test_memory_of_a_text_of_equal_words():
    """Three million equal words, and as many that repeat in turn, stay far below an executor's memory."""
    import subprocess
    import sys

    code = """
import resource
from loamwork.llm import repetition
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for text in ("w " * 3_000_000, "one two three " * 1_000_000):
    (row,) = repetition.measure_all([text], 5, 3).itertuples(index=False)
    assert row.n_words == row.n_repeat_words == 3_000_000 and row.longest_repeat in (2_999_999, 2_999_997), row
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout) < 600


def test_long_texts_are_numbered_alike(monkeypatch):
    text = "a b\x0ba\x0cc\r\nb  a\tc ü ü"
    want = repetition.number_words(text).tolist()
    monkeypatch.setattr(repetition, "LONG_BYTES", 0)
    assert repetition.number_words(text).tolist() == want == [0, 1, 0, 2, 1, 0, 2, 3, 3]
