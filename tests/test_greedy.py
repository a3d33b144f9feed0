import random

from loamwork.functions.greedy import keep_first, leaders
from loamwork.operators import models


def test_keep_first_matches_a_plain_loop(spark):
    rng = random.Random(4)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)) if a != b}
    pairs |= {(100 + i, 101 + i) for i in range(12)}
    near = {}
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
        near.setdefault(a, set())
    kept, lead = set(), {}
    for i in sorted(near):
        earlier = {j for j in near[i] if j in kept}
        lead[i] = min(earlier, default=i)
        if not earlier:
            kept.add(i)
    df = spark.createDataFrame(sorted(pairs), "a int, b int")
    assert {r.id: r.kept for r in keep_first(df).collect()} == {i: i in kept for i in near}
    assert {r.id: r.leader for r in leaders(df).collect()} == lead
    assert keep_first(df.limit(0)).count() == 0


def test_failed_calls_are_null(spark):
    def ask(p):
        if "x" in p:
            raise RuntimeError
        return p.upper()

    df = spark.createDataFrame([(1, "ab"), (2, "ax"), (3, None)], "id int, p string")
    assert {r.id: r.response for r in models.call(df, "p", ask).collect()} == {1: "AB", 2: None, 3: None}
