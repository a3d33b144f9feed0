"""Mail threads as chunks: reply paths, windows of mails, chunk rows.

mail: thread, pos (place in the thread's input, from 0), id, parent, date,
subject, body, sender struct(name, email), to and cc array<struct(name, email)>.
Texts stay on the JVM: what Python sees are ids, keys and lengths of one thread
or path at a time, so a task's memory follows the mails of the largest thread,
not their texts.  Null ids, parents, dates, texts and lists count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import let
from .email import participant_label

#: Of a path that shares more mails than this with a newer one, only so many of them are kept as context.
SHARED, CONTEXT = 4, 3

_ISO = r"^(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d)(:\d\d(?:\.\d{1,6})?)?)?(Z|[+-]\d\d:\d\d)?$"


def date_key(date: Column, message_id: Column) -> Column:
    """struct(parsed, text, id) by which mails sort; dates that are no ISO dates come first (EML-29)."""
    text = F.trim(F.coalesce(date, F.lit("")))
    part = lambda k: F.regexp_extract(text, _ISO, k)
    clock = F.when(part(2) == "", "00:00:00").when(part(3) == "", F.concat(part(2), F.lit(":00"))).otherwise(F.concat(part(2), part(3)))
    valid = text.rlike(_ISO) & F.concat(part(1), F.lit(" "), F.substring(clock, 1, 8)).try_cast("timestamp").isNotNull()
    iso = F.concat(part(1), F.lit("T"), clock, F.when(part(4) == "Z", "+00:00").otherwise(part(4)))
    return F.struct(F.coalesce(valid, F.lit(False)).cast("int").alias("parsed"), F.when(valid, iso).otherwise(text).alias("text"), message_id.alias("id"))


def _names(ids: list[str], positions: list[int]) -> tuple[list[str], dict[str, int]]:
    """A name of its own for each mail, and which mail an id means: the first that bears it."""
    names, first = [], {}
    for k, (i, pos) in enumerate(zip(ids, positions, strict=True)):
        names.append(f"{i}__dup_{pos}" if i in first else i)
        first.setdefault(i, k)
    return names, first


def _components(up: list[int | None], names: list[str]) -> list[list[int]]:
    """Mails that replies connect, each component by name, components by their first name."""
    root = list(range(len(up)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, p in enumerate(up):
        if p is not None:
            root[find(k)] = find(p)
    groups: dict[int, list[int]] = {}
    for k in sorted(range(len(up)), key=names.__getitem__):
        groups.setdefault(find(k), []).append(k)
    return list(groups.values())


def _upwards(start: int, up: list[int | None]) -> list[int]:
    """From a mail to its root, or to where a cycle closes; root first."""
    path, seen, at = [], set(), start
    while at is not None and at not in seen:
        seen.add(at)
        path.append(at)
        at = up[at]
    return path[::-1]


def _compacted(paths: list[list[int]], order: list[tuple], shared: int, context: int) -> list[list[int]]:
    """Paths newest first; one that repeats more than *shared* mails of an earlier one keeps *context* of them.

    Kept paths lie in a trie, so a path is compared with all of them at once.
    """
    trie: dict = {}
    out = []
    for k in sorted(range(len(paths)), key=order.__getitem__, reverse=True):
        node, depth = trie, 0
        for mail in paths[k]:
            if mail not in node:
                break
            node, depth = node[mail], depth + 1
        path = paths[k][max(0, depth - context) :] if depth > shared else paths[k]
        node = trie
        for mail in path:
            node = node.setdefault(mail, {})
        out.append(path)
    return out


def thread_paths(rows: list[tuple], compact: bool = True, shared: int = SHARED, context: int = CONTEXT) -> list[tuple[str, int, list[int]]]:
    """Paths (kind, component, mails) of one thread; rows: (pos, id, parent, date key) in the thread's order."""
    ids = [r[1] or f"missing_id_{r[0]}" for r in rows]
    names, first = _names(ids, [r[0] for r in rows])
    up = [first.get(r[2]) if r[2] else None for r in rows]
    keys = [(*r[3][:2], i) for r, i in zip(rows, ids, strict=True)]
    has_reply = {p for p in up if p is not None}
    out: list[tuple[str, int, list[int]]] = []
    for number, members in enumerate(_components(up, names)):
        leaves = sorted((k for k in members if k not in has_reply), key=keys.__getitem__, reverse=True)
        if leaves:
            whole = [_upwards(k, up) for k in leaves]
            if compact and len(whole) > 1:
                some = _compacted(whole, [(keys[p[-1]], names[p[-1]]) for p in whole], shared, context)
                kept, known = {tuple(p) for p in some}, {tuple(p) for p in whole}
                whole = [p for p in whole if tuple(p) in kept] + [p for p in some if tuple(p) not in known]
            out += [("leaf_path", number, p) for p in whole]
        elif len(members) == 1:
            out.append(("orphan_component", number, members))
        else:  # every mail has an answer and answers one: a cycle, broken at its newest mail
            newest = max(members, key=lambda k: (keys[k], names[k]))
            out.append(("cycle_component", number, _upwards(newest, up)))
    covered = {k for *_, p in out for k in p}
    out += [("orphan_component", -1, [k]) for k in sorted(set(range(len(rows))) - covered, key=names.__getitem__)]
    return out


def reply_paths(mail: DataFrame, compact: bool = True, shared: int = SHARED, context: int = CONTEXT) -> DataFrame:
    """Paths from root to leaf of each thread's replies: thread, path, kind, component, place, pos (EML-25, 26, 34).

    A reply to an unknown mail starts a path; equal ids after the first are
    mails of their own; every mail is in some path.  Only ids and date keys
    reach Python, a thread at a time.
    """
    kind = mail.schema["thread"].dataType.simpleString()
    key = date_key(F.col("date"), F.lit(""))
    small = mail.select("thread", "pos", F.trim(F.coalesce("id", F.lit(""))).alias("id"), F.trim(F.coalesce("parent", F.lit(""))).alias("parent"), key["parsed"].alias("parsed"), key["text"].alias("date"))

    def paths(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pos")
        rows = [(p, i, up, (ok, d)) for p, i, up, ok, d in zip(t["pos"], t["id"], t["parent"], t["parsed"], t["date"], strict=True)]
        found = thread_paths(rows, compact, shared, context)
        flat = [(t["thread"].iloc[0], n, what, c, place, rows[k][0]) for n, (what, c, path) in enumerate(found) for place, k in enumerate(path, 1)]
        return pd.DataFrame(flat, columns=["thread", "path", "kind", "component", "place", "pos"])

    return small.groupBy("thread").applyInPandas(paths, f"thread {kind}, path int, kind string, component int, place int, pos bigint")


def address_text(a: Column) -> Column:
    """Name <email>, one of them, or unknown; names that are their address stand once (EML-30)."""
    name, email = F.trim(F.coalesce(a["name"], F.lit(""))), F.trim(F.coalesce(a["email"], F.lit("")))
    both = F.when(F.lower(name) == F.lower(email), name).otherwise(F.concat(name, F.lit(" <"), email, F.lit(">")))
    return F.when((name != "") & (email != ""), both).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.nullif(email, F.lit("")), F.lit("unknown")))


def day(date: Column) -> Column:
    return F.substring(F.coalesce(date, F.lit("")), 1, 10)


def block(place: Column, date: Column, sender: Column, to: Column, cc: Column, body: Column) -> Column:
    """A mail as text: a line of place, day and addresses, then the body (EML-28)."""
    people = lambda a: F.array_join(F.transform(F.coalesce(a, F.array().cast("array<struct<name:string,email:string>>")), address_text), "; ")
    start = F.concat(F.lit("[msg #"), place.cast("string"), F.lit(" | "), F.coalesce(F.nullif(day(date), F.lit("")), F.lit("unknown date")), F.lit(" | "))
    copies = F.when(people(cc) != "", F.concat(F.lit(" | cc: "), people(cc))).otherwise("")
    return F.concat(start, address_text(sender), F.lit(" -> "), people(to), copies, F.lit("]\n"), F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")))


def path_windows(lengths: list[int], short: list[int], most_mails: int, most_chars: int, overlap: int) -> Iterator[tuple[int, int]]:
    """First and last places, from 0, of a path's windows; short: lengths of the mails if cut to open a window."""
    start, last = 0, -1
    while start < len(lengths):
        end = start
        used = (short[start] if lengths[start] > most_chars else lengths[start]) + 2
        while end + 1 < len(lengths) and end + 1 - start < most_mails and used + lengths[end + 1] + 2 <= most_chars:
            end += 1
            used += lengths[end] + 2
        if end <= last:  # nothing new
            start = last + 1
            continue
        yield start, end
        if end == len(lengths) - 1:
            return
        last = end
        start += max(1, end - start + 1 - overlap)


def windows(blocks: DataFrame, most_mails: int = 10, most_chars: int = 2048, overlap: int = 2) -> DataFrame:
    """Windows of each path that overlap by mails: thread, path, window, first, last place (EML-27).

    blocks: thread, path, place (from 1), length, short.  A window ends before
    the mail that would pass either bound; its first mail is taken whatever its
    length.  One that adds no mail to the window before is skipped.
    """
    overlap = min(overlap, most_mails - 1)
    kind = blocks.schema["thread"].dataType.simpleString()

    def cut(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("place")
        found = list(path_windows(t["length"].tolist(), t["short"].tolist(), most_mails, most_chars, overlap))
        return pd.DataFrame([(t["thread"].iloc[0], t["path"].iloc[0], n, a + 1, b + 1) for n, (a, b) in enumerate(found)], columns=["thread", "path", "window", "first", "last"])

    small = blocks.select("thread", "path", "place", "length", "short")
    return small.groupBy("thread", "path").applyInPandas(cut, f"thread {kind}, path int, window int, first int, last int")


def path_blocks(mail: DataFrame, most_chars: int = 2048, compact: bool = True) -> DataFrame:
    """The mails of each path with their text, whole and cut to open a window, and the lengths of both."""
    rows = reply_paths(mail, compact).join(mail, ["thread", "pos"])
    parts = (F.col("place"), F.col("date"), F.col("sender"), F.col("to"), F.col("cc"))
    cut = F.concat(F.substring(F.coalesce("body", F.lit("")), 1, most_chars), F.lit(" [truncated]"))
    rows = rows.withColumn("text", block(*parts, F.col("body"))).withColumn("cut", block(*parts, cut))
    return rows.withColumn("length", F.length("text")).withColumn("short", F.length("cut"))


def compact_names(names: Column, most: int = 3) -> Column:
    """The first names and how many more there are (EML-28)."""
    few = F.array_join(F.slice(names, 1, most), ", ")
    more = F.when(F.size(names) > most, F.concat(F.lit(" (+"), (F.size(names) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(names) > 0, F.concat(few, more)).otherwise("unknown")


def thread_chunks(mail: DataFrame, most_mails: int = 10, most_chars: int = 2048, overlap: int = 2) -> DataFrame:
    """Chunk rows of each thread: its paths' windows with header, people, days and neighbours (EML-28).

    Returns thread, idx (from 0, over the thread's chunks), chunk_id,
    parent_chunk_id (empty for a path's first), child_chunk_ids, subject (of the
    path's first mail), date_start, date_end, participants (lower case, in order
    of appearance), thread_message_count (of the path), content.  As windows of
    a path start no later than one past the end of the one before, a chunk's
    parent is the one before and its child the one after.
    """
    blocks = path_blocks(mail, most_chars)
    spans = windows(blocks, most_mails, most_chars, overlap)
    keys = ["thread", "path", "window"]
    own = spans.join(blocks, ["thread", "path"]).where(F.col("place").between(F.col("first"), F.col("last")))
    none = F.array().cast("array<struct<name:string,email:string>>")
    everyone = F.concat(F.array("sender"), F.coalesce("to", none), F.coalesce("cc", none))
    label = lambda a: let(F.trim(F.coalesce(F.nullif(a["name"], F.lit("")), a["email"], F.lit(""))), participant_label)
    people = own.select(*keys, "place", F.posexplode(everyone).alias("at", "a")).select(*keys, "place", "at", label(F.col("a")).alias("label")).where("label <> ''")
    people = people.groupBy(*keys, F.lower("label").alias("token")).agg(F.min(F.struct("place", "at", "label")).alias("s"))
    people = people.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s.place", "s.at", "s.label", "token"))).alias("p"))
    people = people.select(*keys, F.col("p.label").alias("names"), F.col("p.token").alias("participants"))
    text = F.when((F.col("place") == F.col("first")) & (F.col("length") > most_chars), F.col("cut")).otherwise(F.col("text"))
    mails = own.select(*keys, "first", F.struct("place", text.alias("text"), day(F.col("date")).alias("day")).alias("m")).groupBy(*keys, "first").agg(F.array_sort(F.collect_list("m")).alias("m"))
    heads = blocks.groupBy("thread", "path").agg(F.min_by(F.coalesce("subject", F.lit("")), "place").alias("subject"), F.count("*").alias("thread_message_count"))
    rows = mails.join(heads, ["thread", "path"]).join(people, keys, "left")
    chunk = lambda step: F.concat_ws("-", F.col("thread").cast("string"), F.col("path").cast("string"), (F.col("window") + 1 + step).cast("string"))
    start, end = F.col("m")[0]["day"], F.get("m", F.size("m") - 1)["day"]
    range_ = F.when((start != "") & (end != ""), F.concat(start, F.lit(" to "), end)).otherwise(F.coalesce(F.nullif(start, F.lit("")), F.nullif(end, F.lit("")), F.lit("unknown")))
    names = F.filter(F.transform(F.split(F.array_join("names", ", "), ","), lambda n: F.trim(n)), lambda n: n != "")
    content = F.concat(
        F.lit("Subject: "), F.coalesce(F.nullif("subject", F.lit("")), F.lit("unknown")), F.lit("\nDate: "), range_,
        F.lit("\nParticipants: "), F.coalesce(compact_names(names), F.lit("unknown")), F.lit("\n\n"), F.array_join("m.text", "\n\n"),
    )
    order, path = Window.partitionBy("thread").orderBy("path", "window"), Window.partitionBy("thread", "path")
    last = F.max("window").over(path)
    return rows.select(
        "thread",
        (F.row_number().over(order) - 1).alias("idx"),
        chunk(0).alias("chunk_id"),
        F.when(F.col("window") > 0, chunk(-1)).otherwise("").alias("parent_chunk_id"),
        F.when(F.col("window") < last, F.array(chunk(1))).otherwise(F.array().cast("array<string>")).alias("child_chunk_ids"),
        "subject",
        start.alias("date_start"),
        end.alias("date_end"),
        F.coalesce("participants", F.array().cast("array<string>")).alias("participants"),
        "thread_message_count",
        content.alias("content"),
    )
