import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loamwork.llm import packing


def rows_of(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, offset string").repartition(3)
    return packing.pack(docs, **more).collect()


def check_exact(texts, rows, size):
    encoder = packing.ByteBpe("byte_bpe_50k.json", None)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        want = [*encoder.encode(t or ""), 1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        got = b"".join(p.ids for p in pieces)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert all(p.doc_tokens == len(want) and p.length * 4 == len(p.ids) for p in pieces)
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        n = sum(p.length for p in pieces)
        assert n <= size
        total += n
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding / total


@pytest.mark.parametrize("size", [64, 2048])
def test_round_trip_and_padding(spark, size):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "heit", "éau", "12", "x!"]) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += [None, "", "   ", "<|endoftext|> a", "日本 語 x", " " * 3000, "w" * 5000, "the " * 20_000]
    assert check_exact(texts, rows_of(spark, texts, size=size), size) < 0.02


def test_memory_bound_keeps_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 3)
    texts = ["the " * 40 for _ in range(60)]
    assert check_exact(texts, rows_of(spark, texts, size=64), 64) < 0.02


def test_empty_table_and_null_ids(spark):
    assert rows_of(spark, []) == []
    docs = spark.createDataFrame([(None, "a b"), (None, None), (3, "a"), (3, "a")], "doc_id bigint, text string")
    got = packing.pack(docs).collect()
    assert sorted(r.doc_id or -1 for r in got if r.start == 0) == [-1, -1, 3, 3]


def test_the_choice_minimises_the_sum_of_squares():
    rng = random.Random(8)
    packer, level = packing.SumOfSquares(20), [0] * 21
    for _ in range(500):
        n = rng.randint(1, 19)

        def after(h):
            new = level[:]
            if h:
                new[h] -= 1
            if h + n < 20:
                new[h + n] += 1
            return sum(x * x for x in new[1:20])

        best = min([0, *(h for h in range(1, 21 - n) if level[h])], key=lambda h: (after(h), -h))
        packer.place((0, 0, np.zeros(n, "<u4"), n), n)
        if best:
            level[best] -= 1
        if best + n < 20:
            level[best + n] += 1
        assert packer.level.tolist()[1:20] == level[1:20]


def test_crc_of_the_ids():
    ids = np.array([1, 50256], dtype="<u4")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"\x01\0\0\0\x50\xc4\0\0")
