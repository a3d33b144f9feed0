"""Quality rules from the repeated substrings of a text, found by a suffix array."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Words whose suffixes are sorted at once; a longer text is sorted by itself.
CHUNK_WORDS = 60_000
#: The words of a longer text are numbered one by one, without a list of them.
LONG_BYTES = 4 << 20
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys among the distinct ones, from 1."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    steps = np.empty(len(keys), dtype=np.int64)
    steps[0] = 1
    np.not_equal(keys[1:], keys[:-1], out=steps[1:], casting="unsafe")
    np.cumsum(steps, out=steps)
    out = np.empty_like(steps)
    out[order] = steps
    return out


def _common_by_levels(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the suffixes i and j have in common: where the ranks of a doubling agree, that many more words do."""
    i, j, n = i.copy(), j.copy(), len(levels[0])
    common = np.zeros(len(i), dtype=np.int64)
    for k in reversed(range(len(levels))):
        inside = (i < n) & (j < n)
        same = np.zeros(len(i), dtype=bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        grow = same.astype(np.int64) << k
        common += grow
        i += grow
        j += grow
    return common


def _common_in_text_order(ids: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """The same of neighbours in the suffix array, in the order of the text and without any further table.

    A suffix shares with its neighbour at most one word less than the suffix
    before it did with its own, so the words are compared about twice each.
    """
    n = len(ids)
    before = np.full(n, -1, dtype=np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    words, other, out = memoryview(np.ascontiguousarray(ids)), memoryview(before), np.zeros(n, dtype=np.int64)
    found, h = memoryview(out), 0
    for i in range(n):
        j = other[i]
        if j < 0:
            h = 0
            continue
        most = n - max(i, j)
        while h < most and words[i + h] == words[j + h]:
            h += 1
        found[i] = h
        if h:
            h -= 1
    return out[suffixes[1:]]


def longest_repeats(ids: np.ndarray, most_levels_words: int = CHUNK_WORDS) -> np.ndarray:
    """Per position the length of the longest substring from there that stands elsewhere, too.

    The suffixes are ranked by prefix doubling.  Neighbours in the suffix array
    are then compared by the ranks of all doublings, which are kept up to
    *most_levels_words* words; beyond, to bound the memory, word by word in the
    order of the text, which gives the same.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    rank = _ranks(ids)
    levels, step = [rank], 1
    while rank.max() < n:
        pair = rank * (n + 1)
        if step < n:
            pair[: n - step] += rank[step:]
        rank = _ranks(pair)
        del pair
        if n <= most_levels_words:
            levels.append(rank)
        step *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank - 1] = np.arange(n)
    if n <= most_levels_words:
        common = _common_by_levels(levels, suffixes[:-1], suffixes[1:])
    else:
        del rank, levels
        common = _common_in_text_order(ids, suffixes)
    out = np.zeros(n, dtype=np.int64)
    out[suffixes[:-1]] = common
    out[suffixes[1:]] = np.maximum(out[suffixes[1:]], common)
    return out


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Marks the positions inside a repeated substring of *least* words or more."""
    edge = np.zeros(len(repeats) + 1, dtype=np.int64)
    at = np.flatnonzero(repeats >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + repeats[at], -1)
    return np.cumsum(edge[:-1]) > 0


def maximal_spans(repeats: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spans [start, end) of the maximal repeated substrings of *least* words or more.

    A position starts one unless the repeat from the position before, less one
    word, is as long: then it is only a tail of that.
    """
    before = np.concatenate(([0], repeats[:-1]))
    at = np.flatnonzero((repeats >= least) & (before <= repeats))
    return [(int(s), int(s + repeats[s])) for s in at]


def _line_repeats(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if not line.strip(" \t\n\v\f\r"):
            continue
        n += line in seen
        seen.add(line)
    return n


def number_words(text: str | None) -> np.ndarray:
    """The words of a text as numbers from 0, in order of their first places."""
    data, numbers = (text or "").encode("utf-8", "surrogatepass"), {}
    words = data.split() if len(data) <= LONG_BYTES else (m.group() for m in WORDS.finditer(data))
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64)


def measure_all(texts: list[str | None], least: int, base_width: int) -> pd.DataFrame:
    """The figures of many texts; words get numbers of their own in each text, so repeats never cross texts."""
    rows: list[tuple] = []
    held: list[tuple[str, np.ndarray]] = []

    def measure_held() -> None:
        ids, base, at = np.empty(sum(len(own) for _, own in held), dtype=np.int64), 0, 0
        for _, own in held:
            ids[at : at + len(own)] = own + base
            base += int(own.max(initial=-1)) + 1
            at += len(own)
        repeats = longest_repeats(ids)
        base_cover, cover = covered(repeats, base_width), covered(repeats, least)
        at = 0
        for text, numbers in held:
            n, own = len(numbers), slice(at, at + len(numbers))
            white = sum(map(text.count, " \t\n\v\f\r"))
            rows.append((
                n, len(text) - white, sum(map(text.count, "#*$%&|<>")), _line_repeats(text), int(base_cover[own].sum()),
                float(cover[own].mean()) if n else 0.0, int(repeats[own].max()) if n else 0, len(maximal_spans(repeats[own], least)),
            ))
            at += n
        held.clear()

    total = 0
    for text in texts:
        own = number_words(text)
        if held and total + len(own) > CHUNK_WORDS:
            measure_held()
            total = 0
        held.append((text or "", own))
        total += len(own)
    if held:
        measure_held()
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "longest_repeat", "n_repeats"])


MEASURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("covered", T.DoubleType()), T.StructField("longest_repeat", T.LongType()), T.StructField("n_repeats", T.LongType())]
)


def measures(text: Column, least: int = 5, base_width: int = 3) -> Column:
    """A struct of MEASURES for a text column."""

    small_batches()

    @F.pandas_udf(MEASURES)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield measure_all(list(texts), least, base_width)

    return udf(text)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 5, max_covered: float = 0.3, max_longest: int = 64) -> DataFrame:
    """Repetition figures and verdict of every whole text, one row per input row.

    Words are runs of anything but ASCII white space.  ``covered`` is the share
    of words inside repeated substrings of *least* words or more (the union of
    the maximal ones), ``longest_repeat`` the longest in words, ``n_repeats``
    the count of maximal ones.  The base rule fails texts of fewer than 50
    words and those with more than half of their words in repeated 3-word
    windows; ``kept`` is false if it fails or if covered > *max_covered* or
    longest_repeat > *max_longest*.  A null or empty text has no words, and so
    fails; repeated rows and null ids stay; an empty table gives an empty one;
    other columns are ignored.
    """
    found = docs.select(F.col(id_col), measures(F.col(text_col), least).alias("__m")).select(id_col, "__m.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("covered") <= max_covered) & (F.col("longest_repeat") <= max_longest)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


#: DuckDB SQL for judge() over documents with its defaults, without longest_repeat and n_repeats.
ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts
), grams AS (
  SELECT doc_id, i, hash(x, lead(x) OVER o, lead(x, 2) OVER o) AS g3, hash(x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g5, count(*) OVER (PARTITION BY doc_id) AS n
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, 3 AS n, i, count(*) OVER (PARTITION BY doc_id, g3) AS copies FROM grams WHERE i <= n - 2
  UNION ALL SELECT doc_id, 5, i, count(*) OVER (PARTITION BY doc_id, g5) FROM grams WHERE i <= n - 4
), inside AS (
  SELECT doc_id, n, count(DISTINCT i + k) AS words
  FROM (SELECT doc_id, n, i, unnest(generate_series(0, n - 1)) AS k FROM windows WHERE copies > 1) GROUP BY ALL
), far AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 64)) AS i FROM texts
  WHERE doc_id IN (SELECT doc_id FROM inside WHERE n = 5 AND words >= 65)
), long AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id, hash(list_slice(w, i, i + 64)) AS h FROM far) GROUP BY doc_id, h HAVING count(*) > 1
), lines AS (
  SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL
), figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, (length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce((SELECT sum(n - 1) FROM lines WHERE lines.doc_id = texts.doc_id), 0)::BIGINT AS n_dup_lines,
    coalesce((SELECT words FROM inside WHERE inside.doc_id = texts.doc_id AND n = 3), 0)::BIGINT AS n_repeat_words,
    coalesce((SELECT words FROM inside WHERE inside.doc_id = texts.doc_id AND n = 5), 0) / greatest(len(w), 1) AS covered,
    EXISTS (SELECT 1 FROM long WHERE long.doc_id = texts.doc_id) AS long_repeat
  FROM texts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered <= 0.3 AND NOT long_repeat AS kept
FROM figures
"""
