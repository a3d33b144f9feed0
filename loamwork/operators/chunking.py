"""Chunking of markdown, and views over chunk tables."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


#: Markup that readers do not see: comments, imports, exports, components without content.
HIDDEN_MARKUP = [
    r"(?s)<!--.*?-->",
    r"(?m)^\s*import\s+[^\n]*?from\s+['\"][^'\"]*['\"];?[ \t]*$",
    r"(?ms)^\s*export\s+(?:const|let|var|default)\s+.*?(?=\n\n|\n#|\z)",
    r"(?s)<([A-Z][A-Za-z0-9]*)[^>]*>\s*</\1>",
    r"<[A-Z][A-Za-z0-9]*(?:\s+[^>]*)?\s*/\s*>",
]


def clean_mdx(text: Column) -> Column:
    """The text without HIDDEN_MARKUP outside code, with runs of blank lines as one (CHK-01).

    Fences cut a text into prose and code in turn; code and its fences stay.  A
    null text stays null.
    """
    visible = lambda p: reduce(lambda q, pattern: F.regexp_replace(q, pattern, ""), HIDDEN_MARKUP, p)
    pieces = F.split(text, r"(?m)^```")
    kept = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, visible(p)).otherwise(p))
    return F.regexp_replace(F.array_join(kept, "```"), r"\n\n\n+", "\n\n")


def sections(text: str) -> list[tuple[str, dict[str, str]]]:
    """Text under each header of level 1 to 3, with the headers above it; fences are not searched (CHK-02)."""
    out: list[tuple[str, dict[str, str]]] = []
    heads: dict[str, str] = {}
    lines: list[str] = []
    fenced = False

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append((body, dict(heads)))
        lines.clear()

    for line in text.split("\n"):
        fenced ^= line.startswith("```")
        found = None if fenced else re.match(r"(#{1,3})[ \t]+(.*?)[ \t]*#*$", line)
        if found:
            close()
            level = len(found[1])
            for k in range(level, 4):
                heads.pop(f"h{k}", None)
            heads[f"h{level}"] = found[2]
        lines.append(line)
    close()
    return out


def fuse(parts: list[tuple[str, dict[str, str]]], least: int, most: int) -> list[tuple[str, dict[str, str]]]:
    """Join short neighbours until none can be joined; the first value of a header stays (CHK-03)."""
    while True:
        out: list[tuple[str, dict[str, str]]] = []
        for text, meta in parts:
            if out and len(out[-1][0]) < least and len(out[-1][0]) + len(text) + 2 <= most:
                out[-1] = (out[-1][0] + "\n\n" + text, {**meta, **out[-1][1]})
            else:
                out.append((text, meta))
        if len(out) == len(parts):
            return out
        parts = out


def split_text(text: str, most: int, overlap: int, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most *most* characters, cut at the coarsest separator that does, with overlap (CHK-04)."""
    separators = SEPARATORS if separators is None else separators
    if len(text) <= most:
        return [text.strip()] if text.strip() else []
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep else []
    units = list(text) if sep == "" else [u + sep for u in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out: list[str] = []
    held: list[str] = []
    size = 0
    for u in units:
        if len(u) > most:
            if "".join(held).strip():
                out.append("".join(held).strip())
            held, size = [], 0
            out += split_text(u, most, overlap, finer)
            continue
        if size + len(u) > most:
            out.append("".join(held).strip())
            while held and (size > overlap or size + len(u) > most):
                size -= len(held.pop(0))
        held.append(u)
        size += len(u)
    if "".join(held).strip():
        out.append("".join(held).strip())
    return [o for o in out if o]


def chunk_hash(metadata: dict, content: str) -> str:
    """sha256 of the sorted metadata and the content."""
    return hashlib.sha256((json.dumps(metadata, indent=2, sort_keys=True) + "\n" + content).encode()).hexdigest()


def chunk_markdown(files: DataFrame, *, least: int = 1024, most: int = 2048, overlap: int = 128) -> DataFrame:
    """files (file, text) to chunks (hash, file, idx, content, h1, h2, h3) (CHK-02 to 05).  One file's text is one row's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                idx = 0
                for body, meta in fuse(sections(text or ""), least, most):
                    for piece in split_text(body, most, overlap):
                        rows.append((chunk_hash({**meta, "file": file, "index": idx}, piece), file, idx, piece, meta.get("h1"), meta.get("h2"), meta.get("h3")))
                        idx += 1
            yield pd.DataFrame(rows, columns=["hash", "file", "idx", "content", "h1", "h2", "h3"])

    return files.select("file", "text").mapInPandas(run, "hash string, file string, idx int, content string, h1 string, h2 string, h3 string")


def repeated_hashes(chunks: DataFrame) -> DataFrame:
    """Hashes that occur more than once (CHK-06)."""
    return chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


def tree_summary(chunks: DataFrame) -> DataFrame:
    """Chunk counts and sizes by folder, by file and in all (CHK-07).  chunks: folder, file, content."""
    n = F.length("content")
    return chunks.rollup("folder", "file").agg(F.count("*").alias("n"), F.min(n).alias("smallest"), F.max(n).alias("largest"), F.floor(F.avg(n)).alias("mean"))


def neighbours(chunks: DataFrame, k: int = 1) -> DataFrame:
    """Ids of the k chunks before and after in the file (CHK-08)."""
    w = Window.partitionBy("file").orderBy("idx")
    ids = lambda lo, hi: F.array_join(F.transform(F.collect_list("id").over(w.rowsBetween(lo, hi)), lambda i: i.cast("string")), ",")
    return chunks.select("id", ids(-k, -1).alias("before"), ids(1, k).alias("after"))


def previews(chunks: DataFrame, chars: int = 80) -> DataFrame:
    """Tail of the chunk before and head of the one after, with marks and placeholders (CHK-09)."""
    w = Window.partitionBy("file").orderBy("idx")
    before, after = F.lag("content").over(w), F.lead("content").over(w)
    tail = F.when(F.length(before) > chars, F.concat(F.lit("..."), F.right(before, F.lit(chars)))).otherwise(before)
    head = F.when(F.length(after) > chars, F.concat(F.left(after, F.lit(chars)), F.lit("..."))).otherwise(after)
    return chunks.select("id", F.coalesce(tail, F.lit("(start of file)")).alias("before"), F.coalesce(head, F.lit("(end of file)")).alias("after"))


def top_level(chunks: DataFrame) -> DataFrame:
    """Chunks of the files with the fewest slashes (CHK-10): the least depth is one aggregate, not a window over all."""
    depth = F.length("file") - F.length(F.replace(F.col("file"), F.lit("/"), F.lit("")))
    least = chunks.agg(F.min(depth).alias("least"))
    return chunks.join(F.broadcast(least)).where(depth == F.col("least")).drop("least")
