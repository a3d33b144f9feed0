"""Set similarity of array columns.  Empty sets are treated as each caller says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once.

    An expression named inside a lambda is computed anew for every element; a
    variable bound by an outer lambda is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _safe_range(n: Column) -> Column:
    """0 .. n-1, empty if n < 1 (sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams."""
    return let(text, lambda t: F.array_distinct(F.transform(_safe_range(F.length(t) - (n - 1)), lambda i: F.substr(t, i + 1, F.lit(n)))))


def word_ngrams(words: Column, n: int) -> Column:
    """Distinct word n-grams, joined by spaces."""
    return let(words, lambda w: F.array_distinct(F.transform(_safe_range(F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i + 1, n), " "))))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if just one is empty."""

    def similarity(s: Column) -> Column:
        x, y = F.size(s["a"]), F.size(s["b"])
        shared = F.size(F.array_intersect(s["a"], s["b"]))
        return F.when((x == 0) & (y == 0), F.lit(both_empty)).otherwise(let(shared, lambda k: k / (x + y - k)))

    return let(F.struct(a.alias("a"), b.alias("b")), similarity)


def containment(a: Column, b: Column) -> Column:
    """Share of a's values that b holds; null if a is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))
