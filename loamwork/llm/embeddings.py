"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, parallelism, release
from .graph import connected_components, merge_labels

#: Candidate pairs that are verified at once.
PAIRS_AT_ONCE = 20_000
#: Bits of a cell number for each of a block's coordinates.
CELL_BITS = 7
#: A coordinate of a turned unit vector is kept as so many steps, in 16 bits.
STEPS = 32767


def rotate(unit: np.ndarray, blocks: int, seed: int = 17) -> np.ndarray:
    """Turn unit vectors by signed Walsh-Hadamard transforms and deal the coordinates to blocks.

    Rows are padded with noughts to a power of two that *blocks* divides.  Only
    elementwise sums are used, so that a row's result does not depend on the
    rows beside it: (n, blocks, coordinates).
    """
    n, dim = unit.shape
    size = blocks
    while size < dim:
        size *= 2
    out = np.zeros((n, size))
    out[:, :dim] = unit
    rng = np.random.default_rng(seed)
    for _ in range(3):
        out = out * rng.choice([-1.0, 1.0], size)
        half = 1
        while half < size:
            pair = out.reshape(n, size // (2 * half), 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, size)
            half *= 2
        out = out[:, rng.permutation(size)] * (1.0 / np.sqrt(size))
    return out.reshape(n, blocks, size // blocks)


def unit_rows(vectors: list | np.ndarray) -> np.ndarray:
    """Vectors of one length in double precision, scaled to norm 1."""
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def block_budget(threshold: float, blocks: int) -> float:
    """Squared distance that at least one of the blocks stays within, for a pair at the threshold."""
    return (2.0 - 2.0 * threshold) / blocks * (1 + 1e-9) + 1e-12


def rounding(coordinates: int) -> float:
    """How far rounding to steps can move a point of so many coordinates."""
    return 0.5 / STEPS * coordinates**0.5 * (1 + 1e-6) + 1e-9


def step_budget(threshold: float, blocks: int, size: int) -> float:
    """The block budget between rounded points, as a squared distance in steps."""
    return (STEPS * (block_budget(threshold, blocks) ** 0.5 + 2 * rounding(size // blocks))) ** 2


def sketches(vec: Column, blocks: int) -> Column:
    """Turned unit vectors with coordinates rounded to 1 / STEPS, as little-endian 16-bit numbers."""

    @F.arrow_udf(T.BinaryType())
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            out = np.empty(len(vectors), dtype=object)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                for lo in range(0, len(at), 2000):
                    some = at[lo : lo + 2000]
                    raw = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), int(n))
                    steps = np.rint(rotate(unit_rows(raw), blocks) * STEPS).astype("<i2").reshape(len(some), -1)
                    out[some] = [row.tobytes() for row in steps]
            yield pa.array(out, type=pa.binary())

    return udf(vec)


def turned_back(sketch: pd.Series, blocks: int) -> np.ndarray:
    """Sketches of one length as whole numbers of steps: (n, blocks, coordinates)."""
    return np.frombuffer(b"".join(sketch), dtype="<i2").reshape(len(sketch), blocks, -1).astype(np.float64)


def cells(block: np.ndarray, dims: np.ndarray, radius: float, side: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Grid cells of one block's points: (row numbers, cell numbers, role).

    Role 0 is a point's own cell, over its first dims[i] coordinates.  Role 1
    are later cells, by number, that reach within *radius* of the point: two
    points within that distance meet in just one cell, as both live there or as
    the one in the lower cell visits the other's.
    """
    n, width = block.shape
    every = np.arange(n)
    for k in np.unique(dims):
        at = every[dims == k]
        k = min(int(k), width)
        x = block[at, :k] / side
        own = np.floor(x).astype(np.int64)
        gap = x - own
        weights = np.int64(1) << (CELL_BITS * np.arange(k, dtype=np.int64))
        home = ((own + (1 << CELL_BITS - 1)) * weights).sum(axis=1)
        yield at, home, 0
        reach = (radius / side) ** 2 * (1 + 1e-9)
        rows, cost, shift = np.arange(len(at)), np.zeros(len(at)), np.zeros(len(at), dtype=np.int64)
        for d in range(k):
            low, high = cost + gap[rows, d] ** 2, cost + (1 - gap[rows, d]) ** 2
            down, up = low <= reach, high <= reach
            rows = np.concatenate([rows, rows[down], rows[up]])
            shift = np.concatenate([shift, shift[down] - weights[d], shift[up] + weights[d]])
            cost = np.concatenate([cost, low[down], high[up]])
        later = shift > 0
        yield at[rows[later]], home[rows[later]] + shift[later], 1


def leaf_links(turned: np.ndarray, copies: np.ndarray, role: np.ndarray, side: np.ndarray, alone: bool, b: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts and labels of the points of one cell, and the pairs that rounding leaves open.

    A pair is compared if one point lives here and the other lives or visits
    here; in a cell dealt out in chunks, if they come from different ones.  It
    counts in the first block whose squared distance is within the budget.  All
    sums are of whole numbers of steps and exact, so every task decides alike.
    A pair is a link, or none, if it is so wherever rounding moved its points
    from; what lies nearer to the threshold is left open.
    """
    n, blocks, width = turned.shape
    size = blocks * width
    budget, most = step_budget(threshold, blocks, size), (2.0 - 2.0 * threshold) ** 0.5
    apart = 2 * rounding(size)
    sure, never = (STEPS * max(0.0, most - apart)) ** 2, (STEPS * (most + apart)) ** 2
    own = turned[:, b]
    square = (own * own).sum(axis=1)
    links, label, still = np.zeros(n, dtype=np.int64), np.arange(n), []
    homes = np.flatnonzero(role == 0)
    step = max(1, 4_000_000 // max(1, n))
    for lo in range(0, len(homes), step):
        some = homes[lo : lo + step]
        far = square[some, None] + square[None, :] - 2 * own[some] @ own.T
        near = far <= budget
        near &= (role == 1)[None, :] | (np.arange(n)[None, :] > some[:, None])
        if not alone:
            near &= side[some, None] != side[None, :]
        left, right = np.nonzero(near)
        left = some[left]
        for at in range(0, len(left), PAIRS_AT_ONCE):
            i, j = left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE]
            gap = turned[i] - turned[j]
            square_gap = (gap * gap).sum(axis=2)
            first = ~(square_gap[:, :b] <= budget).any(axis=1)
            i, j, whole = i[first], j[first], square_gap[first].sum(axis=1)
            open_pairs = (whole > sure) & (whole <= never)
            still.append(np.stack([i[open_pairs], j[open_pairs]], axis=1))
            hit = whole <= sure
            i, j = i[hit], j[hit]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            merge_labels(label, i, j)
    return links, label, np.concatenate([np.zeros((0, 2), dtype=np.int64), *still])


_CELL = ["grp", "b", "cell", "c0", "c1"]


def _deal(blocks: int, threshold: float, with_points: bool):
    """Rows (grp, b, cell, role, cid[, copies, sketch]) of every point, for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            for size, own in t.groupby(t["sketch"].str.len() // 2, sort=False):
                radius = step_budget(threshold, blocks, int(size)) ** 0.5 / STEPS
                side = max(2.5 * radius, 1.0 / ((1 << CELL_BITS - 1) - 2))
                turned = turned_back(own["sketch"], blocks) / STEPS
                grp, cid = own["grp"].to_numpy(), own["cid"].to_numpy()
                for b in range(blocks):
                    for at, cell, role in cells(turned[:, b], own["k"].to_numpy(), radius, side):
                        for lo in range(0, len(at), 20_000):
                            rows, place = at[lo : lo + 20_000], cell[lo : lo + 20_000]
                            out = {"grp": grp[rows], "b": np.full(len(rows), b, dtype=np.int32), "cell": place, "role": np.full(len(rows), role, dtype=np.int32), "cid": cid[rows]}
                            if with_points:
                                out |= {"copies": own["copies"].to_numpy()[rows], "sketch": own["sketch"].to_numpy()[rows]}
                            types = {"sketch": pa.binary()}
                            yield pa.RecordBatch.from_arrays([pa.array(v, type=types.get(k)) for k, v in out.items()], names=list(out))

    return run


def _join(blocks: int, threshold: float):
    """Rows (a, b, n): n links of a; or a and b in one class, n = 0; or a pair left open, n null."""

    def links(t: pd.DataFrame) -> pa.RecordBatch:
        cid = t["cid"].to_numpy()
        alone = bool(t["c0"].iloc[0] == t["c1"].iloc[0])
        found, label, still = leaf_links(turned_back(t["sketch"], blocks), t["copies"].to_numpy(), t["role"].to_numpy(), t["side"].to_numpy(), alone, int(t["b"].iloc[0]), threshold)
        some, joined = np.flatnonzero(found), np.flatnonzero(label != np.arange(len(t)))
        a = np.concatenate([cid[some], cid[joined], cid[still[:, 0]]])
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cid[label[joined]], type=pa.int64()), pa.array(cid[still[:, 1]], type=pa.int64())])
        n = pa.concat_arrays([pa.array(found[some], type=pa.int64()), pa.array(np.zeros(len(joined), dtype=np.int64)), pa.nulls(len(still), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), b, n], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        for batch in batches:
            t = batch.to_pandas()
            t = t if held is None else pd.concat([held, t], ignore_index=True)
            keys = t[_CELL].to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip(np.concatenate(([0], cut[:-1])), cut, strict=True) if len(cut) else ():
                if hi - lo > 1:
                    yield links(t.iloc[lo:hi])
            held = t.iloc[cut[-1] if len(cut) else 0 :]
        if held is not None and len(held) > 1:
            yield links(held)

    return run


def _verify(threshold: float):
    """Of pairs with their vectors (a, b, ca, cb, x, y), those with cosine >= threshold in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            hit = np.zeros(len(t), dtype=bool)
            for lo in range(0, len(t), 2000):
                for _, own in t.iloc[lo : lo + 2000].groupby(t["x"].str.len(), sort=False):
                    x, y = (np.array(own[c].tolist(), dtype=np.float64) for c in ("x", "y"))
                    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
                    dot = lambda u, v: np.einsum("ij,ij->i", u, v)
                    hit[own.index] = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))) >= threshold
            t = t[hit]
            yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy(), type=pa.int64()) for c in ("a", "b", "ca", "cb")], names=["a", "b", "ca", "cb"])

    return run


def _settled(still: DataFrame, classes: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, n) of the links among the pairs left open, whose vectors are fetched for it."""
    ends = still.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    ends = ends.join(classes.select("cid", "h1", "h2", "copies"), "cid")
    ends = ends.join(known.select("h1", "h2", "vec"), ["h1", "h2"]).groupBy("cid").agg(F.first("copies").alias("c"), F.first("vec").alias("v"))
    ends = materialise(ends, "ends")
    pairs = still.join(ends.select(F.col("cid").alias("a"), F.col("c").alias("ca"), F.col("v").alias("x")), "a")
    pairs = pairs.join(ends.select(F.col("cid").alias("b"), F.col("c").alias("cb"), F.col("v").alias("y")), "b")
    hits = pairs.select("a", "b", "ca", "cb", "x", "y").mapInArrow(_verify(threshold), "a bigint, b bigint, ca bigint, cb bigint")
    both = F.array(F.struct("a", "b", F.col("cb").alias("n")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ca").alias("n")))
    return hits.select(F.explode(both).alias("r")).select("r.*")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98, blocks: int = 4, leaf_rows: int = 4096) -> DataFrame:
    """Near-duplicate classes of all vectors with equal labels, by cosine in double precision.

    Unit vectors with cosine >= threshold lie within a squared distance of
    2 - 2 threshold; turned and split into *blocks* subspaces, in one of them at
    least they lie within that budget divided by the number of blocks.  Each
    block is range-joined on a grid whose cells use as many coordinates as its
    label's count asks for.  What is dealt to the cells are ids and coordinates
    of 16 bits, with budgets widened by what rounding can do; the union of the
    candidates is verified exactly: by these coordinates where rounding cannot
    matter (all but a band of about 1e-4 about the threshold), else by the
    vectors themselves, fetched for those pairs alone.  Equal vectors form a
    class that is joined once.  A cell of more than 2 * *leaf_rows* points is
    dealt out as pairs of chunks.  Tasks return link counts and spanning trees,
    not pairs, but for those in the band.

    Returns one row per input row: the id, ``n_links`` (other vectors linked
    directly), ``component_id`` (smallest id reachable, itself included),
    ``kept`` (id = component_id).  Vectors that are null, empty, nought or hold
    null or non-finite components, and rows with a null label, link with
    nothing; vectors of different lengths do not link.  A null id takes part
    but is never a component_id unless its whole component has none; repeated
    ids stay repeated; other columns are ignored; an empty table gives an empty
    table.  With label_col None all vectors are compared.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
    fine = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    fine &= F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    marks = [F.xxhash64(F.lit(s), F.col("label"), F.col("vec")).alias(f"h{s}") for s in (1, 2)]
    known = materialise(rows.where("fine").select("id", F.xxhash64("label", F.size("vec")).alias("grp"), *marks, "vec", sketches(F.col("vec"), blocks).alias("sketch")), "vectors")
    classes = known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("grp").alias("grp"), F.first("sketch").alias("sketch"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    sizes = classes.groupBy("grp").agg(F.count("*").alias("n"))
    k = F.least(F.lit(56 // CELL_BITS), F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / leaf_rows) / F.log(F.lit(3.0)))))
    points = classes.join(sizes, "grp").select("grp", "cid", "copies", "sketch", k.cast("int").alias("k"))
    points = materialise(points, "points")
    place = "grp bigint, b int, cell bigint, role int, cid bigint"
    bare = points.mapInArrow(_deal(blocks, threshold, False), place)
    full = bare.groupBy("grp", "b", "cell").count().where(F.col("count") > 2 * leaf_rows)
    full = materialise(full.select("grp", "b", "cell", F.ceil(F.col("count") / leaf_rows).cast("int").alias("chunks")), "full")
    dealt = points.mapInArrow(_deal(blocks, threshold, True), f"{place}, copies bigint, sketch binary")
    dealt = dealt.join(full, ["grp", "b", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), "chunks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("grp", "b", "cell", F.least("own", "with").alias("c0"), F.greatest("own", "with").alias("c1"), (F.col("own") > F.col("with")).cast("int").alias("side"), "role", "cid", "copies", "sketch")
    dealt = dealt.repartition(parallelism(spark), *_CELL).sortWithinPartitions(*_CELL)
    found = materialise(dealt.mapInArrow(_join(blocks, threshold), "a bigint, b bigint, n bigint"), "links")
    settled = materialise(_settled(found.where("n is null").select("a", "b"), classes, known, threshold), "settled")
    linked = found.where("n is not null").union(settled)
    counts = linked.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = materialise(connected_components(linked.where("b is not null").select("a", "b")).withColumnRenamed("vertex", "cid"), "roots")
    known_classes = classes.select("cid", "h1", "h2", "rep", "copies").join(roots, "cid", "left").join(counts, "cid", "left")
    known_classes = known_classes.select("h1", "h2", "rep", F.coalesce("root", "cid").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    known_classes = materialise(known_classes, "linked")
    least = materialise(known_classes.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = materialise(known_classes.join(least, "root").select("h1", "h2", "n_links", "component_id"), "named")
    out = known.select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    release(classes, points, full, found, settled, roots, known_classes, least)
    out = out.union(rows.where(~F.col("fine")).select("id", F.lit(0).cast("bigint"), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: DuckDB SQL for near_duplicates() over embeddings with its defaults.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.a
"""
