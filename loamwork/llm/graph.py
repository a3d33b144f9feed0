"""Connected components of an edge table, without any step on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j; label points to the smallest member of a class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _signature(edges: DataFrame) -> tuple:
    """Row count and order-free digest of an edge table; two numbers reach the driver."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Roots of the vertices in *edges* (a bigint, b bigint).

    Alternates the large-star and small-star contractions until the edges form
    stars.  Each half step takes neighbourhood minima with a map-side combined
    aggregate, written to the shared folder, so that the join that follows has
    two plain exchanges and Spark may split a vertex with very many edges.

    Returns (vertex, root): every vertex of an edge whose ends differ, with the
    smallest vertex that it reaches.  Vertices without such an edge, and edges
    with a null end, are left out.  An empty table gives an empty table.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialise(plain.distinct(), "edges")
    seen = _signature(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "edges")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b")))
        small = materialise(small.distinct(), "edges")
        release(now, low, large, least)
        now, before = small, seen
        seen = _signature(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return stars.union(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
