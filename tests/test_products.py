"""Weights of shared names by products of blocks, against all pairs."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamwork.functions import products
from loamwork.operators import linking


def brute(edges, quality, digits):
    q = {n: Decimal(str(quality.get(n, 0.5))) for n, _ in edges}
    held = {}
    for n, i in edges:
        held.setdefault(i, []).append(n)
    part = lambda a, b: float(Decimal(repr(float(a) / b)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    out = {}
    for a, x in held.items():
        for b, y in held.items():
            both = [n for n in x for m in y if n == m]
            if a != b and both:
                s = sum(q[n] for n in both)
                out[a, b] = (part(s, len(x)), part(sum(q[m] for m in y) - s, len(y)))
    return out


def test_blocks_meet_both_ways_whatever_the_weights(monkeypatch):
    monkeypatch.setattr(products, "STEP", 8)
    monkeypatch.setattr(products, "PAIRS", 64)
    rng = random.Random(4)
    names = [f"n{j}" for j in range(30)]
    edges = [(n, i) for i in range(70) for n in rng.sample(names, rng.randint(0, 9))]
    edges += edges[:5] + [(f"only{i}", i) for i in range(60, 75)] + [(names[0], -(2**40))]
    for quality in ({}, {n: rng.choice([0.3, 0.8]) for n in names}, {n: rng.choice([0, -0.25, 1.123456789, 70.5]) for n in names}):
        for blocks in (1, 3):
            dealt = [[(n, i) for n, i in edges if i % blocks == k] for k in range(blocks)]
            parts = [{"block": [k] * len(e), "name": [n for n, _ in e], "id": [i for _, i in e], "u": [round(quality.get(n, 0.5) * 10**9) for n, _ in e]} for k, e in enumerate(dealt)]
            packed = [products._packed(pa.table(p)) for p in parts]
            pairs = [pa.table({f"{s}_{c}": t[c] for s, t in (("x", packed[i]), ("y", packed[j])) for c in t.column_names}) for i in range(blocks) for j in range(i, blocks)]
            rows = [r for b in products._Scores(9)(b for p in pairs for b in p.to_batches()) for r in b.to_pylist()]
            got = {(r["pid"], i): (r["shared"], new) for r in rows for i, new in zip(r["ids"], r["news"], strict=True)}
            assert got == brute(edges, quality, 9) and len(got) == sum(len(r["ids"]) for r in rows) > 1000


def test_ids_of_another_type_and_null(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "y"), ("a", None), ("c", "z")]
    got = products.shared_scores(spark.createDataFrame(rows, "name string, id string").withColumn("q", F.lit(0.5)), 6, 2)
    assert sorted(map(tuple, got.collect())) == [("x", "y", 0.5, 0.25), ("y", "x", 0.25, 0.0)]
    assert products.shared_scores(got.selectExpr("pid name", "id", "shared q").limit(0), 6).count() == 0


def test_halves_of_a_rounding_go_up_as_in_spark(spark):
    x = [0.5, 1.5, 2.5, 0.125, 0.375, 1.005, 2.675, 0.285, 1 / 3, 0.0, 123456.785, 0.045, 8.325]
    want = [r.r for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 2).alias("r")).collect()]
    assert products.rounded(np.array(x), 2).tolist() == want


def test_graph_scores_of_all_chunks_make_no_row_per_shared_name(spark):
    edges = spark.range(300).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda j: F.concat(F.lit("n"), j.cast("string")))).alias("name"), "id")
    scores = linking.graph_scores(edges, edges.limit(0).selectExpr("name", "0.5D q"))
    assert tuple(scores.agg(F.count("*"), F.min("shared"), F.max("new")).first()) == (300 * 299, 0.5, 0.0)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert not any("name" in line for line in plan.splitlines() if "Join" in line)
