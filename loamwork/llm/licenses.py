"""License scans: phrases, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: What separates words, in a lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose consecutive words mark a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of common licenses, by label; no two that differ by a word only.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc0": ["Released into the public domain under CC0 1.0 Universal."],
}


#: Fixed value: templates of so many distinct words or fewer need a word of their own.
SHORT = 8
#: The Kelvin sign is the one other character that lower() turns into a letter of ASCII.
KELVIN, ANGSTROM = "\u212a", "\u212b"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _words(text: str) -> list[str]:
    """Words of a template or phrase; A-Z are lower-cased."""
    return [w for w in re.split(SEPARATORS, text.translate(_LOWER)) if w]


def tokens(text: str) -> list[str]:
    """Distinct words of a template, sorted."""
    return sorted(set(_words(text)))


def _span(text: str) -> int:
    """The words of a template, rounded up to a power of two from 8."""
    return max(8, 1 << (len(_words(text)) - 1).bit_length())


def _lowered(text: Column, wanted: Sequence[str]) -> Column:
    """The text with A-Z lower-cased.

    lower() also changes other letters, which no word of ASCII letters is made
    of; where such words are wanted, only A-Z are touched.
    """
    if all(w.isascii() for w in wanted):
        return F.lower(F.replace(text, F.lit(KELVIN), F.lit(ANGSTROM)))
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _array(values: Sequence, kind: str) -> str:
    """SQL for an array of words or numbers."""
    return "cast(array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f") as array<{kind}>)"


def _places(numbers: Sequence[int]) -> str:
    """SQL for the hits at which the words with these numbers stand consecutively."""
    follows = " AND ".join(f"get(hits, k + {d}).u = {u} AND get(hits, k + {d}).at = get(hits, k).at + {d}" for d, u in enumerate(numbers) if d)
    return f"filter(sequence(0, greatest(size(hits) - 1, 0)), k -> get(hits, k).u = {numbers[0]}{' AND ' + follows if follows else ''})"


def _probes(span: int, wanted: Sequence[int]) -> str:
    """SQL for the stretches around hits whose word is *wanted*: (span, block, rank, ranks of the distinct words there).

    A stretch has 2 * span words and starts at a multiple of span, so two hold a
    word; as a word is one hit, the hits around it within 2 * span places hold all.
    """
    near = f"filter(slice(hits, greatest(k + 2 - {2 * span}, 1), {4 * span - 1}), h -> h.at >= b * {span} AND h.at < (b + 2) * {span})"
    ranks = f"array_sort(array_distinct(transform({near}, h -> ranks[h.u])))"
    struct = f"named_struct('span', {span}, 'block', b, 'rank', ranks[hits[k].u], 'ranks', {ranks})"
    blocks = f"filter(array(hits[k].at div {span}, hits[k].at div {span} - 1), b -> b >= 0)"
    some = f"filter(sequence(0, greatest(size(hits) - 1, 0)), k -> k < size(hits) AND get(ranks, get(hits, k).u) IN ({', '.join(map(str, wanted))}))"
    return f"flatten(transform({some}, k -> transform({blocks}, b -> {struct})))"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8, windows: bool = True) -> DataFrame:
    """License phrases and templates in every whole text, one row per input row.

    Base: places where a phrase's words stand consecutively (over line ends,
    too).  Method: the text's blocks are stretches of its words regardless of
    line ends or, without *windows*, its lines; a block matches a template if it
    holds at least *threshold* of the template's distinct words.  Stretches have
    twice the template's words, rounded up to 8, 16, 32 ..., and start anew every
    half, so that each window of a template's length lies in one of them; of a
    template of SHORT words or fewer they must hold a word that no other label
    has.

    Each text is reduced to its hits, the places of words that some template or
    phrase has; phrases are found in these.  The words are counted over all
    texts and ordered by that frequency, rarest first.  A template that needs m
    of its n words must share one of its first n - m + 1 with a matching block
    (prefix filter), so only blocks around such words are built; the block must
    have m words (length filter); and the words that follow the shared one in
    both orders must suffice (positional filter).  What is left is verified by
    the exact overlap.  Only the templates' prefixes are broadcast, whose size
    the parameter *templates* bounds.

    Returns id, n_words, n_base, first_word, last_word, base_labels, labels (base
    and method), score (1 with a base place, else the largest containment at or
    over the threshold, else 0) and n_blocks (matching pairs of block and
    template).  A null text is empty; rows with null or repeated ids are
    scanned each by itself; an empty table gives an empty table; other columns
    are ignored.
    """
    spark = docs.sparkSession
    known = sorted({(label, tuple(tokens(t)), _span(t) if windows else 0) for label, texts in templates.items() for t in texts if tokens(t)})
    needs = [math.ceil(threshold * len(words) - 1e-9) for _, words, _ in known]
    sayings = [(_words(p), label) for p, label in phrases.items() if _words(p)]
    of_templates = sorted({w for _, words, _ in known for w in words})
    universe = of_templates + sorted({w for words, _ in sayings for w in words} - set(of_templates))
    number = {w: k for k, w in enumerate(universe)}
    text = _lowered(F.coalesce(F.col(text_col), F.lit("")), universe)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), text.alias("text"))
    words = rf"array_remove(split(text, r'{SEPARATORS}'), '')"
    if windows:
        rows = rows.withColumn("words", F.expr(words))
    else:  # the line of each word stands beside it
        rows = rows.withColumn("lines", F.expr(rf"transform(split(text, '\n'), l -> array_remove(split(l, r'{SEPARATORS}'), ''))"))
        rows = rows.withColumn("words", F.flatten("lines"))
    hit = f"if(w IN ({', '.join(repr(w) for w in universe) or 'NULL'}), named_struct('at', i, 'u', cast(array_position({_array(universe, 'string')}, w) - 1 as int)), null)"
    hits = F.expr(f"filter(transform(words, (w, i) -> {hit}), h -> h is not null)") if universe else F.expr("cast(array() as array<struct<at: int, u: int>>)")
    rows = rows.select("row", id_col, F.size("words").cast("bigint").alias("n_words"), hits.alias("hits"), *([] if windows else [F.expr(f"transform(lines, l -> array_intersect(l, {_array(of_templates, 'string')}))").alias("lines")]))
    rows = materialise(rows, "scanned")
    counts = {r["u"]: r["n"] for r in rows.select(F.explode("hits.u").alias("u")).groupBy("u").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(len(universe)), key=lambda u: (counts.get(u, 0), u))
    rank = {universe[u]: k for k, u in enumerate(order)}
    entries, starts = [], {}
    for (label, words_of, span), need in zip(known, needs, strict=True):
        own = sorted(rank[w] for w in words_of)
        others = {w for other, theirs, _ in known if other != label for w in theirs}
        marks = [rank[w] for w in words_of if w not in others] if windows and len(words_of) <= SHORT else []
        prefix = own[: len(own) - need + 1]
        starts.setdefault(span, set()).update(prefix)
        entries += [(r, label, i, need, own, span, marks) for i, r in enumerate(prefix)]
    prefixes = spark.createDataFrame(entries, "rank int, label string, i int, need int, own array<int>, span int, marks array<int>")
    ranks = _array([rank[w] for w in universe], "int")
    if windows:
        found = ", ".join(_probes(span, sorted(wanted)) for span, wanted in sorted(starts.items()))
        probes = rows.select("row", F.expr(f"transform(array({ranks}), ranks -> concat({found}))[0]" if found else "cast(array() as array<struct<span: int, block: int, rank: int, ranks: array<int>>>)").alias("probes"))
        # explode() would have its argument computed a second time, in a filter that it implies
        probes = probes.select("row", F.explode_outer("probes").alias("p")).where("p is not null").select("row", "p.*")
    else:
        lines = rows.select("row", F.posexplode("lines").alias("block", "b")).where("size(b) > 0")
        place = f"array_sort(transform(b, w -> {ranks}[array_position({_array(universe, 'string')}, w) - 1]))"
        probes = lines.select("row", "block", F.lit(0).alias("span"), F.expr(place).alias("ranks")).select("*", F.explode("ranks").alias("rank"))
    pairs = probes.join(F.broadcast(prefixes), ["rank", "span"]).where(F.size("ranks") >= F.col("need"))
    j = F.array_position("ranks", F.col("rank")) - 1
    pairs = pairs.where(F.least(F.size("own") - F.col("i"), F.size("ranks") - j) >= F.col("need"))
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("ranks", "own"))).where("overlap >= need AND (size(marks) = 0 OR arrays_overlap(marks, ranks))")
    pairs = pairs.select("row", "block", "label", "own", (F.col("overlap") / F.size("own")).alias("share")).distinct()
    matched = pairs.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.count("*").alias("n_blocks"))
    based = ", ".join(f"transform({_places([number[w] for w in saying])}, k -> named_struct('at', hits[k].at, 'label', '{label}'))" for saying, label in sayings)
    base = F.expr(f"concat({based})" if based else "cast(null as array<struct<at: int, label: string>>)")
    base = F.coalesce(base, F.expr("cast(array() as array<struct<at: int, label: string>>)"))
    joined = rows.select("row", id_col, "n_words", base.alias("base")).join(matched, "row", "left")
    places, own = F.col("base.at"), F.array_distinct(F.col("base.label"))
    return joined.select(
        id_col,
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"),
    )


def _oracle() -> str:
    """DuckDB SQL for scan() over documents with its defaults: every stretch of words against every template."""
    known = sorted({(label, tuple(tokens(t)), _span(t)) for label, texts in TEMPLATES.items() for t in texts})
    values = ", ".join(
        f"('{label}', {list(words)!r}, {math.ceil(0.8 * len(words) - 1e-9)}, {span}, {[w for w in words if len(words) <= SHORT and all(w not in x for o, x, _ in known if o != label)]!r}::VARCHAR[])"
        for label, words, span in known
    )
    places = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - {len(p.split())})) AS i FROM words) WHERE "
        + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in PHRASES.items()
    )
    blocks = " UNION ALL ".join(f"SELECT doc_id, {s} AS span, unnest(list_transform(generate_series(0, greatest(len(w) - 1, 0), {s}), lambda i: list_slice(w, i + 1, i + {2 * s}))) AS b FROM words" for s in sorted({s for *_, s in known}))
    return f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{SEPARATORS}'), lambda x: x <> '') AS w FROM texts),
base AS ({places}),
blocks AS ({blocks}),
templates(label, own, need, span, marks) AS (VALUES {values}),
pairs AS (SELECT doc_id, label, len(list_intersect(b, own)) AS overlap, len(own) AS size, need
  FROM blocks JOIN templates USING (span) WHERE len(own) > {SHORT} OR len(marks) = 0 OR list_has_any(b, marks)),
matched AS (SELECT doc_id, list(DISTINCT label) AS more, max(overlap / size) AS share, count(*) AS n_blocks FROM pairs WHERE overlap >= need GROUP BY doc_id),
based AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS own FROM base GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(list_aggregate(list_sort(own), 'string_agg', ','), '') AS base_labels,
  coalesce(list_aggregate(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), 'string_agg', ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM words LEFT JOIN based USING (doc_id) LEFT JOIN matched USING (doc_id)
"""


ORACLE = _oracle()
