import math

import numpy as np
import pytest

from loamwork.llm import embeddings


def plain(rows, threshold=0.98):
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    near = {r[0]: set() for r in rows}
    x = {r[0]: np.array(r[1], dtype=np.float64) for r in ok}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = x[a[0]], x[b[0]]
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= threshold:
                    near[a[0]].add(b[0])
                    near[b[0]].add(a[0])
    out = {}
    for r in rows:
        seen, todo = {r[0]}, [r[0]]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[r[0]] = (len(near[r[0]]), min(seen), min(seen) == r[0])
    return out


def cloud(rng, n, dim):
    rows, base = [], rng.normal(size=(6, dim))
    for i in range(n):
        if i % 3 == 0:
            v = rng.normal(size=dim)
        else:
            v = base[i % 6] + rng.normal(size=dim) * rng.choice([0.05, 0.12, 0.2])
        if i % 7 == 0 and rows:
            v = np.array(rows[i // 2][1]) * rng.choice([1, 1, 2.5])
        rows.append((i, np.float32(v).tolist(), int(i % 2)))
    return rows


@pytest.mark.parametrize(("dim", "leaf_rows"), [(64, 4096), (64, 20), (10, 30), (3, 10)])
def test_links_match_brute_force(spark, dim, leaf_rows):
    rng = np.random.default_rng(dim + leaf_rows)
    rows = cloud(rng, 260, dim)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, leaf_rows=leaf_rows).collect()}
    assert got == plain(rows)


def test_odd_rows(spark):
    one, nan = [1.0, 0.0], float("nan")
    rows = [(1, one, 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [float("inf"), 0.0], 0), (7, one, None), (8, one, 1), (9, [2.0, 0.0], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == plain(rows)
    assert got[9] == (1, 1, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)], "vec_id bigint, embedding array<float>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == [(-1, 0, -1, True), (-1, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]


def test_the_turn_keeps_lengths():
    rng = np.random.default_rng(0)
    u = embeddings.unit_rows(rng.normal(size=(50, 48)).tolist())
    r = embeddings.rotate(u, 8)
    assert np.allclose((r**2).sum(axis=(1, 2)), 1)
    assert np.allclose(r.reshape(50, -1) @ r.reshape(50, -1).T, u @ u.T)
    assert np.array_equal(embeddings.rotate(u[7:9], 8), r[7:9])


def test_pairs_about_the_threshold_are_settled_by_the_vectors(spark):
    """Pairs of cosines closer to 0.98 than rounding can tell, on both sides, and copies of them."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(120):
        a = rng.normal(size=24)
        a /= np.linalg.norm(a)
        b = rng.normal(size=24)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cos = 0.98 + (k % 7 - 3 or 4) * 10.0 ** -(3 + k % 9)
        rows += [(3 * k, a.tolist(), 0), (3 * k + 1, (cos * a + math.sqrt(1 - cos * cos) * b).tolist(), 0)]
        if k % 5 == 0:
            rows.append((3 * k + 2, (2 * a).tolist(), 0))
        if k % 6 == 0:
            rows.append((1000 + k, rows[-1][1], 0))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, leaf_rows=60).collect()}
    want = plain(rows)
    assert got == want and 20 < sum(n > 0 for n, _, _ in want.values()) < len(rows)


@pytest.mark.parametrize("blocks", [2, 8])
def test_other_numbers_of_blocks(spark, blocks):
    rows = cloud(np.random.default_rng(blocks), 200, 20)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, blocks=blocks, leaf_rows=20).collect()}
    assert got == plain(rows)
