"""Toxicity: a classifier whose scores may not follow the identity terms of a text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_batches, trainable

#: Terms that stand for each other, by kind; counterfactual texts swap them within a kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("africans", "americans", "europeans", "asians", "mexicans"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
)

WORDS = re.compile(r"[^\W\d_]+")
#: Counts at which a feature counts again, as another one.
STEPS = (1, 2, 4)


def bucket(feature: str, step: int, dims: int) -> int:
    return zlib.crc32(f"{feature}#{step}".encode()) % dims


def parts(word: str) -> list[str]:
    """A word's features: itself and its beginnings, for words are inflected and compounded."""
    return [word, *("^" + word[:k] for k in range(3, 8) if len(word) > k)]


def features(words: Counter, dims: int) -> set[int]:
    """Buckets of a text's words, by how often their features occur."""
    counts: Counter = Counter()
    for word, n in words.items():
        for f in parts(word):
            counts[f] += n
    return {bucket(f, s, dims) for f, n in counts.items() for s in STEPS if n >= s}


def counterfactuals(words: Counter, groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[Counter]:
    """The words with each present kind of identity terms swapped for the next and the last of its kind."""
    out = []
    for group in groups:
        if not any(t in words for t in group):
            continue
        for turn in dict.fromkeys((1, len(group) - 1)):
            other = Counter({w: n for w, n in words.items() if w not in group})
            for k, t in enumerate(group):
                if t in words:
                    other[group[(k + turn) % len(group)]] += words[t]
            out.append(other)
    return out


@dataclass
class ToxicityModel:
    """Weights by bucket; an empty model scores nought."""

    dims: int = 1 << 18
    weights: dict[int, float] = field(default_factory=dict)
    bias: float | None = None


def differences(own: Sequence[int], others: Sequence[Sequence[int]]) -> tuple[list[int], list[int], list[int]]:
    """What the counterfactuals change: features, 1 where one is lost and -1 where one is won, and whose they are."""
    moved, sign, at, mine = [], [], [], set(own)
    for k, other in enumerate(others):
        theirs = set(other)
        for gone, s in ((mine - theirs, 1), (theirs - mine, -1)):
            moved += sorted(gone)
            sign += [s] * len(gone)
            at += [k] * len(gone)
    return moved, sign, at


def fit(y: np.ndarray, own: Sequence[np.ndarray], changes: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray, int]], width: int, *, penalty: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty on score changes between a text and its counterfactuals.

    own: each text's features, numbered below width; changes: its differences()
    and how many counterfactuals it has.  Texts without any take no part in the penalty.
    """
    y = np.asarray(y, dtype=np.float64)
    row = np.repeat(np.arange(len(y)), [len(x) for x in own])
    col = np.concatenate([np.zeros(0, dtype=np.int32), *own])
    first_pair = np.cumsum([0, *(n for *_, n in changes)])
    n_pairs = int(first_pair[-1])
    moved = np.concatenate([np.zeros(0, dtype=np.int32), *(m for m, *_ in changes)])
    sign = np.concatenate([np.zeros(0), *(s.astype(np.float64) for _, s, *_ in changes)])
    at = np.concatenate([np.zeros(0, dtype=np.int64), *(a + f for (_, _, a, _), f in zip(changes, first_pair, strict=False))])
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], len(y)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(col, error[row], width) / len(y) + l2 * w
        if n_pairs:
            gap = np.bincount(at, sign * w[moved], n_pairs)
            grad += 2 * penalty / n_pairs * np.bincount(moved, sign * gap[at], width)
        grad = np.append(grad, error.mean())
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, kept: int = 2048, dims: int = 1 << 18, penalty: float = 1.0, l2: float = 1e-3, steps: int = 300, seed: int = 23) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows that are not held out.

    About *sample_rows* labelled ids are drawn by a hash; their texts are the
    only ones read closely, and of their hashed features the *kept* ones that
    part the labels best (and those of identity terms) get weights.  The driver
    gets, per sampled text, the numbers of its kept features (at most *kept* and
    those of identity terms, 4 bytes each) and what its counterfactuals change
    of them, which only identity terms do: a bound by these parameters at every
    input size.  Features are counts of words, so identity terms are swapped in
    the counts, which gives what swapping them in the sentences would.  Of
    several labels of an id the largest counts; null labels and texts teach
    nothing.  Without labels of both kinds the model is empty.
    """
    spark = docs.sparkSession
    known = labels.where(trainable(F.col(id_col))).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y")).where("y is not null")
    total = known.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("i")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = materialise(known.where(draw < min(1.0, sample_rows / max(1, total))), "drawn")
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    sample = materialise(texts.join(F.broadcast(drawn), "i"), "sample").select("i", "t", "y")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, dims + 1), dtype=np.int64)
        for batch in batches:
            for text, y in zip(batch.column(1), batch.column(2), strict=True):
                own = features(Counter(WORDS.findall(text.as_py().lower())), dims)
                seen[min(1, max(0, y.as_py())), [*own, dims]] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["b", "n0", "n1"])

    counts = materialise(sample.mapInArrow(tally, "b bigint, n0 bigint, n1 bigint").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "tally")
    whole = counts.where(F.col("b") == dims).first()
    if whole is None or not whole["n0"] or not whole["n1"]:
        return ToxicityModel(dims)
    n0, n1 = float(whole["n0"]), float(whole["n1"])
    parting = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt((F.col("n0") + F.col("n1") + 1) / (n0 + n1))
    best = counts.where(F.col("b") < dims).orderBy(parting.desc(), "b").limit(kept).collect()
    chosen = sorted({r["b"] for r in best} | {bucket(f, s, dims) for g in IDENTITY_TERMS for t in g for f in parts(t) for s in STEPS})
    number = {b: k for k, b in enumerate(chosen)}

    kinds = {"y": pa.int32(), "own": pa.binary(), "moved": pa.binary(), "sign": pa.binary(), "at": pa.binary(), "n": pa.int32()}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pick(words: Counter) -> list[int]:
            return sorted(number[b] for b in features(words, dims) if b in number)

        for batch in batches:
            out: list[tuple] = []
            for text, y in zip(batch.column(1), batch.column(2), strict=True):
                words = Counter(WORDS.findall(text.as_py().lower()))
                own = pick(words)
                others = [pick(c) for c in counterfactuals(words)]
                moved, sign, at = differences(own, others)
                packed = [np.array(x, dtype=t).tobytes() for x, t in ((own, "<i4"), (moved, "<i4"), (sign, "i1"), (at, "<i4"))]
                out.append((min(1, max(0, y.as_py())), *packed, len(others)))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    rows = sample.mapInArrow(rows_of, "y int, own binary, moved binary, sign binary, at binary, n int").collect()
    rows = sorted((r["y"], bytes(r["own"]), bytes(r["moved"]), bytes(r["sign"]), bytes(r["at"]), r["n"]) for r in rows)
    own = [np.frombuffer(r[1], dtype="<i4") for r in rows]
    changes = [(np.frombuffer(r[2], dtype="<i4"), np.frombuffer(r[3], dtype="i1"), np.frombuffer(r[4], dtype="<i4"), r[5]) for r in rows]
    weights, bias = fit(np.array([r[0] for r in rows]), own, changes, len(chosen), penalty=penalty, l2=l2, steps=steps)
    return ToxicityModel(dims, {b: float(w) for b, w in zip(chosen, weights, strict=True) if w}, bias)


class Scorer:
    """Scores texts; remembers which features of a word have weights."""

    def __init__(self, model: ToxicityModel, remembered: int = 500_000):
        self.model, self.remembered = model, remembered
        self.words: dict[str, tuple[str, ...]] = {}
        self.features: dict[str, tuple[float, ...]] = {}

    def weighted(self, word: str) -> tuple[str, ...]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > self.remembered:
                self.words.clear()
            weights, dims, found = self.model.weights, self.model.dims, ()
            for f in parts(word):
                own = tuple(weights.get(bucket(f, s, dims), 0.0) for s in STEPS)
                if any(own):
                    self.features[f] = own
                    found += (f,)
            self.words[word] = found
        return found

    def score(self, text: str | None) -> float:
        if self.model.bias is None:
            return 0.0
        counts: dict[str, int] = {}
        for word, n in Counter(WORDS.findall((text or "").lower())).items():
            for f in self.weighted(word):
                counts[f] = counts.get(f, 0) + n
        hit: set[int] = set()
        z = self.model.bias
        for f, n in counts.items():
            for s, w in zip(STEPS, self.features[f], strict=True):
                if w and n >= s and (b := bucket(f, s, self.model.dims)) not in hit:
                    hit.add(b)
                    z += w
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """Score of a text column, 0 to 1; a null or empty text gets the score of no words."""

    small_batches()

    @F.pandas_udf(T.DoubleType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return udf(text)


def predict(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, score, predicted (1 if score >= threshold).

    Whole texts are scored, each by itself.  Null and empty texts get the score
    of a text without words; an empty model scores 0; null and repeated ids
    stay; an empty table gives an empty table; other columns are ignored.
    """
    found = docs.select(F.col(id_col), toxicity(F.col(text_col), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
