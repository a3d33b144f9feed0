"""Self-join of texts by the Jaccard similarity of their character trigrams, by products of short codes.

Trigrams of prose are few and common, so any index on them (prefixes, parts) lets nearly all texts of a language
meet.  What is cheap is to compare codes: a bit per bin of hashed trigrams that says whether the bin holds an odd
number of them.  A trigram that one of two sets lacks turns one bit, so sets that differ in d trigrams differ in d
bits at most.  Blocks of sets meet each other, each pair of blocks as one task; in it, tiles of sets whose shares of a
few sets (pivots) are too far apart are left out whole, and the others meet by a matrix product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .greedy import cut
from .setjoin import give_back, mix

#: Bits of a code, and those of them that the product compares.
BITS, FIRST = 256, 128
#: Sets in a tile.
TILE = 512
#: Sets whose overlap with a set says where it lies; they only order the work.
PIVOTS = 16
#: Blocks, as many as keep all cores busy; more if a block had more than so many sets.
BLOCKS, BLOCK = 12, 250_000


def trigrams(text: str | None) -> np.ndarray:
    """The distinct trigrams of a text's code points in order, each as one number (21 bits a code point)."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    g = np.sort((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    return g[new]


def _digests(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        sets = [trigrams(x) for x in batch["x"].to_pylist()]
        digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["id"], digest, pa.array([len(s) for s in sets], pa.int32()), batch["x"]], ["id", "set", "n", "x"])
    give_back()


def trigram_sets(texts: DataFrame, text: Column) -> DataFrame:
    """(id, set, n, x): a digest and the size of each text's set of trigrams, and the text; texts without one have n = 0."""
    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", text.alias("x")).mapInArrow(_digests, f"id {kind}, set binary, n int, x string")


def classes(sets: DataFrame) -> DataFrame:
    """(k, rep, set, n, x): one row per distinct set that is not empty, its smallest id and one of its texts; written."""
    found = sets.where("n > 0").groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("x").alias("x"))
    return cut(found.where("rep IS NOT NULL").select(F.monotonically_increasing_id().alias("k"), "rep", "set", "n", "x"))


class _Codes:
    """Batches (k, n, block, x) to (k, n, block, code, at): the parities of hashed trigrams, and the overlaps with pivots."""

    def __init__(self, pivots: list[str]):
        sets = [trigrams(x) for x in pivots]
        self.values = np.unique(np.concatenate(sets))
        self.held = np.zeros((len(self.values) + 1, PIVOTS), np.uint16)
        for j, s in enumerate(sets):
            self.held[np.searchsorted(self.values, s), j] = 1

    def __call__(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sets = [trigrams(x) for x in batch["x"].to_pylist()]
                sizes, flat = np.array([len(s) for s in sets]), np.concatenate(sets)
                bins = np.repeat(np.arange(len(sets)), sizes) * BITS + (mix(flat, 3) % np.uint64(BITS)).astype(np.int64)
                odd = (np.bincount(bins, minlength=len(sets) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
                found = np.minimum(np.searchsorted(self.values, flat), len(self.values) - 1)
                found[self.values[found] != flat] = len(self.values)
                at = np.add.reduceat(self.held[found], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int32)
                code = [r.tobytes() for r in np.packbits(odd, axis=1)]
                yield pa.RecordBatch.from_arrays([batch["k"], batch["n"], batch["block"], pa.array(code, pa.binary()), pa.array([r.tobytes() for r in at], pa.binary())], ["k", "n", "block", "code", "at"])
        give_back()


def tiles(place: np.ndarray, size: int = TILE) -> list[np.ndarray]:
    """Rows in groups of size at most, cut at the median of the column that varies most."""
    todo, out = [np.arange(len(place))] if len(place) else [], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        x = place[rows]
        order, half = np.argsort(x[:, x.std(axis=0).argmax()], kind="stable"), len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


class _Side:
    """The sets of a block in tiles: what bounds each tile, and its factor of the product."""

    def __init__(self, table, weight: float, left: bool):
        def bytes_of(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(table.num_rows, -1)

        self.k, self.n = table["k"].to_numpy(), table["n"].to_numpy().astype(np.int64)
        self.code, self.weight, self.left = bytes_of("code", np.uint8), weight, left
        self.words = self.code.view(np.uint64)
        place = np.column_stack([bytes_of("at", np.int32), self.n])
        self.tiles = tiles(place)
        self.low = np.array([place[t].min(axis=0) for t in self.tiles])
        self.high = np.array([place[t].max(axis=0) for t in self.tiles])

    def factor(self, t: int) -> np.ndarray:
        """Bits as 1 and -1, and two columns whose product adds the weighted sizes."""
        rows = self.tiles[t]
        out = np.empty((len(rows), FIRST + 2), np.float32)
        out[:, :FIRST] = np.unpackbits(self.code[rows, : FIRST // 8], axis=1) * np.float32(2) - 1
        out[:, FIRST + (not self.left)] = self.weight * self.n[rows]
        out[:, FIRST + self.left] = 1
        return out


class _Near:
    """The rows of two blocks to (p, a, b): pairs whose sizes and codes allow a similarity over the threshold."""

    def __init__(self, threshold: float, blocks: int):
        self.share, self.blocks = (1 - threshold) / (1 + threshold), blocks

    def __call__(self, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        p = table["p"][0].as_py()
        i, j = divmod(p, self.blocks)
        x = _Side(table.filter(pc.equal(table["block"], i)), 2 * self.share, True)
        y = _Side(table.filter(pc.equal(table["block"], j)), 2 * self.share, False)
        factors = [y.factor(t) for t in range(len(y.tiles))] if len(x.tiles) else []
        left, right = [], []
        for s, rows in enumerate(x.tiles):
            if not factors:
                break
            apart = np.maximum(x.low[s] - y.high, y.low - x.high[s]).max(axis=1)
            meet = np.flatnonzero(apart <= self.share * (x.high[s, -1] + y.high[:, -1]) + 1e-6)
            factor = x.factor(s)
            for t in meet[meet >= s] if i == j else meet:
                a, b = np.divmod(np.flatnonzero(factor @ factors[t].T >= FIRST - 0.01), len(y.tiles[t]))
                if i == j and s == t:
                    a, b = a[a < b], b[a < b]
                a, b = rows[a], y.tiles[t][b]
                differ = np.bitwise_count(x.words[a] ^ y.words[b]).sum(axis=1)
                most = self.share * (x.n[a] + y.n[b]) + 1e-6
                keep = (differ <= most) & (np.abs(x.n[a] - y.n[b]) <= most)
                left.append(x.k[a[keep]])
                right.append(y.k[b[keep]])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        out = pa.table({"p": pa.array(np.full(len(a), p), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        give_back()
        return out


def _settled(pairs, texts):
    """Pairs of k and the texts of a task to (a, b, shared, either): the ids, and the sizes of what both and either hold."""
    import pyarrow as pa

    order = np.argsort(texts["k"].to_numpy())
    k = texts["k"].to_numpy()[order]
    a, b = (order[np.searchsorted(k, pairs[c].to_numpy())] for c in "ab")
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    sets = [trigrams(x) for x in texts["x"].to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    end = np.cumsum(size)
    value = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    held, shared = np.zeros(len(value), np.int32), np.zeros(len(a), np.int64)
    firsts = np.flatnonzero(np.diff(a, prepend=-1))
    for f, g in zip(firsts, np.append(firsts[1:], len(a)), strict=True):
        own = value[end[a[f]] - size[a[f]] : end[a[f]]]
        held[own] = 1
        for lo in range(f, g, 2000):
            c = b[lo : min(g, lo + 2000)]
            start = np.cumsum(size[c]) - size[c]
            spread = np.arange(size[c].sum()) + np.repeat(end[c] - size[c] - start, size[c])
            shared[lo : lo + len(c)] = np.add.reduceat(held[value[spread]], start)
        held[own] = 0
    rep = texts["rep"].combine_chunks()
    return pa.table({"a": rep.take(pa.array(a)), "b": rep.take(pa.array(b)), "shared": pa.array(shared), "either": pa.array(size[a] + size[b] - shared)})


def near_sets(found: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """(a, b, similarity): pairs of ids (a < b) of *classes* whose sets have Jaccard > threshold, all of them."""
    n = found.count()
    blocks = blocks or max(min(BLOCKS, n // 1000), -(-n // BLOCK), 1)
    pivots = [r.x for r in found.orderBy("set").limit(PIVOTS).select("x").collect()]
    kind = found.schema["rep"].dataType.simpleString()
    near = _Near(threshold, blocks)
    rows = found.select("k", "n", F.pmod(F.xxhash64("set"), F.lit(blocks)).cast("int").alias("block"), "x")
    rows = rows.mapInArrow(_Codes(pivots), "k long, n int, block int, code binary, at binary") if pivots else rows.selectExpr("k", "n", "block", "binary('') code", "binary('') at")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.withColumn("o", other).withColumn("p", (F.least("block", "o") * blocks + F.greatest("block", "o")).cast("long")).drop("o")
    pairs = cut(rows.groupBy("p").applyInArrow(lambda rows: near(rows), "p long, a long, b long"))
    ends = pairs.select(F.col("p").alias("task"), F.explode(F.array("a", "b")).alias("k")).distinct()
    texts = ends.join(found.select("k", "rep", "x"), "k").select("task", "k", "rep", "x")
    exact = pairs.groupBy("p").cogroup(texts.groupBy("task")).applyInArrow(_settled, f"a {kind}, b {kind}, shared long, either long")
    exact = exact.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("shared") / F.col("either")).alias("similarity"))
    return exact.where(F.col("similarity") > threshold)
