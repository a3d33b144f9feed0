"""SimHash fingerprints and their near-duplicate classes, by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialise, parallelism, release, small_batches
from .graph import connected_components, merge_labels

#: Bits of a fingerprint and of each of the blocks of the pigeonhole argument.
BITS, BLOCK = 64, 16
#: Levels by which an overfull trie node is opened at once.
STEP = 8


def fingerprint_of(text: str | None, width: int) -> int:
    """The fingerprint of one text, as an unsigned number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count, ones = max(1, len(words) - width + 1), np.zeros(BITS, dtype=np.int64)
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, count, 1 << 16):
        stop = min(count, start + (1 << 16))
        own = words[start : stop + width - 1]
        hashes = np.array([hash_of(join(s), 42) for s in zip(*(own[k:] for k in range(width)), strict=False)] if len(words) >= width else [hash_of(join(words), 42)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """SimHash of a text column as a bigint (the 64 bits, read as signed).

    A-Z are lower-cased; words are runs of anything but ASCII white space; the
    features are the *width*-word shingles with their repeats, hashed by XXH64
    with seed 42.  A text with fewer words is one shingle; a null text or one
    without words has the fingerprint 0.
    """

    small_batches()

    @F.arrow_udf(T.LongType())
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:  # text by text, so that a batch is held once, in Arrow
            yield pa.array(np.array([fingerprint_of(x.as_py(), width) for x in texts], dtype=np.uint64).view(np.int64))
        give_back()

    return udf(text)


def as_hex(fingerprint: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def trie_join(keys: np.ndarray, pairs: np.ndarray, budget: int, visits: list[int] | None = None) -> np.ndarray:
    """Classes of the keys under links of *budget* differing bits or fewer.

    keys: uint64, sorted within each range.  pairs: rows (a0, a1, b0, b1, depth,
    diff), two nodes of a binary trie as ranges of keys, with the number of
    leading bits that all keys of a node share and how many of those differ
    between the two nodes.  Both nodes of a pair are opened together, bit by
    bit, and the differing bits of their prefixes add up; a pair is pruned once
    they exceed the budget.  A pair of nodes with one key each is a path to one
    pair of leaves: its remaining bits are counted at once.  *visits* collects
    the numbers of node pairs opened.  Returns a label per key.
    """
    label = np.arange(len(keys), dtype=np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [pairs[pairs[:, 4] == d] for d in np.unique(pairs[:, 4])]
    while stack:
        now = stack.pop()
        if len(now) > 50_000:
            stack.append(now[50_000:])
            now = now[:50_000]
        a0, a1, b0, b1, depth, diff = now.T
        d = int(depth[0])
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if d >= BITS:  # equal keys only: all of a pair are linked, through the first of a
            for w, x, y, z in now[:, :4]:
                some = np.concatenate([np.arange(w, x), np.arange(y, z)])
                merge_labels(label, some, np.full(len(some), w))
            continue
        i, j = a0[single], b0[single]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        merge_labels(label, i[near], j[near])
        now = now[~single]
        if not len(now):
            continue
        if visits is not None:
            visits.append(len(now))
        a0, a1, b0, b1, depth, diff = now.T
        if d not in ones:
            bit = (keys >> np.uint64(BITS - 1 - d)) & np.uint64(1)
            ones[d] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        c = ones[d]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, diff, None), (am, a1, bm, b1, diff, None), (a0, am, bm, b1, diff + 1, None), (am, a1, b0, bm, diff + 1, ~same)]
        opened = []
        for w, x, y, z, e, only in parts:
            ok = (x > w) & (z > y) & (e <= budget) & ~(same & (w == y) & (x - w == 1))
            if only is not None:
                ok &= only
            opened.append(np.stack([w, x, y, z, np.full(len(w), d + 1), e], axis=1)[ok])
        opened = np.concatenate(opened)
        if len(opened):
            stack.append(opened)
    return label


def _leaf_links(budget: int, chunk_rows: int = 50_000):
    """Links within whole leaves: rows come sorted by (rot, depth, a, b, side, key)."""

    def links(table: pd.DataFrame) -> pa.RecordBatch:
        cols = {k: table[k].to_numpy() for k in ("rot", "depth", "a", "b", "side")}
        keys = table["key"].to_numpy().view(np.uint64)
        n = len(keys)
        fresh = np.zeros(n, dtype=bool)
        for k in ("rot", "depth", "a", "b"):
            fresh[1:] |= cols[k][1:] != cols[k][:-1]
        fresh[0] = True
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], n)
        right = np.concatenate(([0], np.cumsum(cols["side"])))
        mid = end - (right[end] - right[start])
        alone = cols["a"][start] == cols["b"][start]
        diff = np.bitwise_count((cols["a"][start] ^ cols["b"][start]).view(np.uint64)).astype(np.int64)
        lo, hi = np.where(alone, start, mid), end
        mid = np.where(alone, end, mid)
        pairs = np.stack([start, mid, lo, hi, cols["depth"][start].astype(np.int64), diff], axis=1)
        label = trie_join(keys, pairs[(mid > start) & (hi > lo)], budget)
        i = np.flatnonzero(label != np.arange(n))
        turn = (cols["rot"].astype(np.uint64) * np.uint64(BLOCK)) % np.uint64(BITS)
        back = np.where(turn == 0, keys, (keys >> turn) | (keys << ((np.uint64(BITS) - turn) % np.uint64(BITS))))
        back = back.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back[i]), pa.array(back[label[i]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            held.append(batch.to_pandas())
            rows += batch.num_rows
            if rows < chunk_rows:
                continue
            table = pd.concat(held, ignore_index=True)
            last = table.iloc[-1]
            open_from = int(((table["rot"] == last["rot"]) & (table["depth"] == last["depth"]) & (table["a"] == last["a"]) & (table["b"] == last["b"])).to_numpy().argmax())
            if open_from:
                yield links(table.iloc[:open_from])
            held = [table.iloc[open_from:]]
            rows = len(held[0])
        if rows:
            yield links(pd.concat(held, ignore_index=True))

    return run


_LEAF = ["rot", "depth", "a", "b"]


def _open(members: DataFrame, full: DataFrame, budget: int) -> tuple[DataFrame, list[DataFrame]]:
    """Deal the members of overfull node pairs to the pairs of their children.

    Only the children that exist meet, and only those whose prefixes differ in
    *budget* bits or fewer: the traversal step of the trie join, over nodes.
    Also returns the tables that are read no more once the result is written.
    """
    shift = f"cast({BITS} - depth - {STEP} as int)"
    own = members.join(full, _LEAF, "left_semi").withColumn("child", F.expr(f"shiftrightunsigned(key, {shift})"))
    own = materialise(own, "opened")
    nodes = own.select(*_LEAF, "side", "child").distinct()
    left = nodes.where("side = 0").withColumnRenamed("child", "x").drop("side")
    right = nodes.where("side = 1 or a = b").withColumnRenamed("child", "y").drop("side")
    pairs = left.join(right, _LEAF).where((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y")))
    pairs = pairs.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= budget)
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("to"), F.col("x").alias("child"), F.lit(0).alias("side"))))
    sides = sides.otherwise(F.array(
        F.struct(F.lit(0).alias("to"), F.col("x").alias("child"), F.lit(0).alias("side")),
        F.struct(F.lit(1).alias("to"), F.col("y").alias("child"), F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("side")),
    ))
    pairs = materialise(pairs.select(*_LEAF, "x", "y", F.explode(sides).alias("s")).select(*_LEAF, "x", "y", "s.*"), "pairs")
    dealt = own.join(pairs, [*_LEAF, "side", "child"])
    return dealt.select("rot", (F.col("depth") + STEP).alias("depth"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("to").alias("side"), "key"), [own, pairs]


def fingerprint_links(classes: DataFrame, budget: int = 3, leaf_rows: int | None = None) -> DataFrame:
    """Links (a, b) that join distinct fingerprints at *budget* differing bits or fewer.

    classes: one bigint column ``fp`` without repeats.  Two fingerprints with at
    most 3 differing bits agree in one of four blocks of 16 bits; so each is
    put into four tries, turned so that another block leads, and the error
    budget in the leading block is nought.  A subtree below a block is joined
    by ``trie_join`` in one task.  A node pair with more than *leaf_rows* keys
    (by default a task's fair share of the table) is opened further by a
    shuffle, as often as need be; its children meet only within the budget.
    The links returned are spanning trees of what each task found, so their
    number is bounded by the rows dealt out, not by the pairs.
    """
    if not 0 <= budget < BITS // BLOCK:
        raise ValueError("the budget must be smaller than the number of blocks")
    spark = classes.sparkSession
    turned = ", ".join(f"struct({r} as rot, {'fp' if not r else f'shiftleft(fp, {r * BLOCK}) | shiftrightunsigned(fp, {BITS - r * BLOCK})'} as key)" for r in range(BITS // BLOCK))
    members = classes.select(F.explode(F.expr(f"array({turned})")).alias("m")).select("m.*")
    top = F.expr(f"shiftrightunsigned(key, {BITS - BLOCK})")
    members = members.select("rot", F.lit(BLOCK).alias("depth"), top.alias("a"), top.alias("b"), F.lit(0).alias("side"), "key")
    members = materialise(members, "members")
    if leaf_rows is None:
        leaf_rows = max(256, members.count() // parallelism(spark))
    done, spent = [], []
    while True:
        full = materialise(members.groupBy(*_LEAF).count().where(F.col("count") > leaf_rows).where(F.col("depth") < BITS).drop("count"), "full")
        spent += [members, full]
        if full.isEmpty():
            done.append(members)
            break
        done.append(members.join(full, _LEAF, "left_anti"))
        dealt, used = _open(members, full, budget)
        members = materialise(dealt, "members")
        release(*used)
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.union(more)
    crowded = leaves.repartition(parallelism(spark), *_LEAF).sortWithinPartitions(*_LEAF, "side", "key")
    links = materialise(crowded.mapInArrow(_leaf_links(budget), "a bigint, b bigint"), "links")
    release(*spent)
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, leaf_rows: int | None = None) -> DataFrame:
    """SimHash near-duplicate classes of all texts.

    Returns one row per input row: the id, ``fingerprint`` (16 hex digits),
    ``component_id`` (the smallest id reachable over links, itself included)
    and ``component_key`` (bigint, one value per component).  Rows whose
    fingerprints are equal form a class that is linked as one, so groups of
    copies of any size cost one row.  Null and empty texts have fingerprint 0
    and are linked like any other; a null id is never a component_id unless no
    row of its component has an id; repeated ids stay repeated; an empty table
    gives an empty table; other columns are ignored.
    """
    prints = materialise(docs.select(F.col(id_col), fingerprint(F.col(text_col), width).alias("__fp")), "prints")
    classes = materialise(prints.groupBy("__fp").agg(F.min(id_col).alias("__rep")).withColumnRenamed("__fp", "fp"), "classes")
    links = fingerprint_links(classes.select("fp"), budget, leaf_rows)
    roots = materialise(connected_components(links).select(F.col("vertex").alias("fp"), "root"), "roots")
    known = materialise(classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "__rep"), "rooted")
    least = materialise(known.groupBy("root").agg(F.min("__rep").alias("component_id")), "least")
    named = materialise(known.join(least, "root").select(F.col("fp").alias("__fp"), "component_id", F.col("root").alias("component_key")), "named")
    release(links, classes, roots, known, least)
    return prints.join(named, "__fp").select(id_col, as_hex(F.col("__fp")).alias("fingerprint"), "component_id", "component_key")
