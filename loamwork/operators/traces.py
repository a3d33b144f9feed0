"""Agent traces: windowing into training examples, filters, balance, pivots, splits.

A message table has one row per message: trace, pos (position in the trace),
role, content and, where there are any, calls (array of struct name, arguments).
Examples are keyed by (trace, turn_index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.greedy import cut, leaders
from ..functions.nearsets import classes, near_sets, trigram_sets
from ..functions.sampling import numbered, pinned
from ..functions.sets import containment
from ..functions.text import blank_split, mask_entities

#: Fewest training rows that a run accepts.
MIN_TRAIN = 16


def _trace():
    return Window.partitionBy("trace")


def system_prompts(messages: DataFrame) -> DataFrame:
    """System prompts by use: first system message of each trace, most common first, ties by first trace (TRC-01)."""
    first = messages.where("role = 'system'").groupBy("trace").agg(F.min_by("content", "pos").alias("prompt"))
    counts = first.groupBy("prompt").agg(F.count("*").alias("n"), F.min("trace").alias("first_trace"))
    return numbered(counts, F.desc("n"), "first_trace", name="rank").withColumn("rank", F.col("rank").cast("int"))


def tool_census(messages: DataFrame, samples: int = 3) -> DataFrame:
    """Tools with valid names: calls, argument keys, first safe argument samples (TRC-02)."""
    name = r"^[A-Za-z_][A-Za-z0-9_]*$"
    calls = messages.where("role = 'assistant'").select("trace", "pos", F.posexplode("calls").alias("k", "c")).where(F.col("c.name").rlike(name))
    calls = calls.withColumn("args", F.from_json("c.arguments", "map<string,string>"))
    safe = calls.withColumn("args", F.map_filter(F.coalesce("args", F.create_map().cast("map<string,string>")), lambda k, v: k.rlike(name)))
    order = Window.partitionBy("c.name", F.size("args") > 0).orderBy("trace", "pos", "k")
    safe = safe.withColumn("nth", F.when(F.size("args") > 0, F.row_number().over(order)))
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("args"))))
    return safe.groupBy(F.col("c.name").alias("tool")).agg(
        F.count("*").alias("n_calls"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("args"))))), ",").alias("param_keys"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= samples, F.struct("nth", text.alias("t"))))), lambda s: s["t"]), "; ").alias("sample_args"),
    )


def examples(messages: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per assistant turn that has a prompt (TRC-03).

    The prompt is everything before the turn, less a leading system message; the
    completion is the turn and the tool messages right after it.  turn_index
    counts assistant turns, including those without a prompt.
    """
    upto = _trace().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lead = (F.first("role").over(_trace().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) == "system").cast("int")
    island = F.sum(F.when(F.col("role") != "tool", 1).otherwise(0)).over(_trace().orderBy("pos"))
    rows = messages.withColumn("island", island).withColumn("lead", lead)
    rows = rows.withColumn("n_completion", F.count("*").over(Window.partitionBy("trace", "island")))
    rows = rows.withColumn("n_before", F.count("*").over(upto))
    rows = rows.withColumn("turn_index", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(_trace().orderBy("pos")) - 1)
    if with_text:
        line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), "content")
        rows = rows.withColumn("line", line).withColumn("lines", F.collect_list("line").over(upto))
        own = F.array_sort(F.collect_list(F.struct("pos", "line")).over(Window.partitionBy("trace", "island")))
        rows = rows.withColumn("ground_truth", F.array_join(F.transform(own, lambda s: s["line"]), "\n"))
        rows = rows.withColumn("prompt", F.array_join(F.slice("lines", F.col("lead") + 1, F.greatest(F.lit(0), F.size("lines"))), "\n"))
    rows = rows.where("role = 'assistant'").withColumn("n_prompt", F.col("n_before") - F.col("lead")).where("n_prompt > 0")
    return rows.drop("island", "lead", "n_before", "line", "lines", "role")


def drop_reason(content: Column, calls: Column, relay: Column | None = None, *, min_chars: int = 40, exclude: tuple[str, ...] = (), overlap: float = 0.8) -> Column:
    """The first filter that drops an example, as filter:reason[:detail]; null if it stays (TRC-05, 06, 07, 09)."""
    names = F.transform(calls, lambda c: c["name"])
    excluded = (F.size(names) > 0) & F.forall(names, lambda n: n.isin(*exclude) if exclude else F.lit(False)) & (F.length(content) < 50)
    out = F.when(F.length(content) < min_chars, F.lit("heuristic:too_short")).when(excluded, F.concat(F.lit("tool_calls:excluded:"), F.element_at(names, 1)))
    if relay is not None:
        out = out.when((F.size(calls) == 0) & (relay > overlap), F.lit("tool_relay:relay"))
    return out


def relay_overlap(messages: DataFrame) -> DataFrame:
    """Per assistant turn the largest share of its words that one earlier tool result holds (TRC-07).

    A running pass over the trace collects the word sets of tool results, each
    once; a turn without words, or without a tool result before it, has null.
    """
    tokens = F.array_distinct(F.filter(blank_split(F.lower("content")), lambda w: F.length(w) > 1))
    before = _trace().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("tokens", tokens).withColumn("tools", F.collect_list(F.when((F.col("role") == "tool") & (F.size("tokens") > 0), F.col("tokens"))).over(before))
    return rows.where("role = 'assistant'").withColumn("overlap", F.array_max(F.transform("tools", lambda t: containment(F.col("tokens"), t)))).drop("tools", "tokens")


def near_duplicate_pairs(completions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs (a < b) of completions whose masked character trigrams have Jaccard > threshold (TRC-08).

    completions: id, content.  Completions with equal trigram sets are joined as
    one, by their smallest id; all sets meet by short codes, and those that may
    be near by the sets themselves.
    """
    return near_sets(classes(trigram_sets(completions, mask_entities(F.col("content")))), threshold)


def capped_clusters(completions: DataFrame, keep: int = 3, threshold: float = 0.85) -> DataFrame:
    """(id, leader, kept): greedy leader clusters in id order, of which the first few members stay (TRC-08).

    A completion with the trigram set of another joins its class's leader; those
    too short for a trigram are alike, and so one class.
    """
    sets = cut(trigram_sets(completions, mask_entities(F.col("content"))))
    reps = sets.groupBy("set").agg(F.min("id").alias("rep"))
    found = leaders(cut(near_sets(classes(sets), threshold))).select(F.col("id").alias("rep"), "leader")
    rows = sets.select("id", "set").join(reps.join(found, "rep", "left"), "set")
    rows = rows.select("id", F.coalesce("leader", "rep", "id").alias("leader"))
    place = F.row_number().over(Window.partitionBy("leader").orderBy("id"))
    return rows.withColumn("kept", place <= keep)


def scores(text: Column) -> Column:
    """Numeric scores of a JSON map; booleans count as numbers, other values are null (TRC-19)."""
    found = F.from_json(text, "map<string,string>")
    return F.transform_values(found, lambda k, v: F.when(v.isin("true", "false"), (v == "true").cast("double")).otherwise(v.try_cast("double")))


def outcome_balance(scored: DataFrame, score: str = "score", success: float = 0.5, least_failures: float = 0.15) -> DataFrame:
    """Success, failure and unknown counts and whether failures are frequent enough (TRC-11)."""
    s = F.col(score)
    out = scored.agg(
        F.count("*").alias("total"),
        F.count(F.when(s >= success, 1)).alias("successes"),
        F.count(F.when(s < success, 1)).alias("failures"),
        F.count(F.when(s.isNull(), 1)).alias("unknown"),
    )
    known = F.col("successes") + F.col("failures")
    out = out.withColumn("failure_fraction", F.when(known > 0, F.col("failures") / known).otherwise(0.0))
    return out.withColumn("is_balanced", (known == 0) | (F.col("failure_fraction") >= least_failures))


def score_range(scored: DataFrame, score: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with a score within the range; rows without one go (TRC-12)."""
    keep = F.col(score).isNotNull()
    if low is not None:
        keep &= F.col(score) >= low
    if high is not None:
        keep &= F.col(score) <= high
    return scored.where(keep)


def split(rows: DataFrame, n_train: int, n_eval: int, key: list[str], seed: int = 42) -> DataFrame:
    """Rows of a train/eval split in pinned order (TRC-14); the total is a limit, so a top-n, not a full sort."""
    if n_train < MIN_TRAIN:
        raise ValueError(f"need at least {MIN_TRAIN} training rows, got {n_train}")
    order = [pinned(seed, *map(F.col, key)), *map(F.col, key)]
    chosen = rows.orderBy(*order).limit(n_train + n_eval)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("part", F.when(F.col("place") <= n_train, "train").otherwise("eval"))


#: Greetings, requests for identity, and names of look-up tools.
GREETING = r"(?i)^(hi|hello|hey|good\s+(morning|afternoon|evening)|welcome|greetings)\b"
IDENTITY_REQUEST = r"(?i)\b(provide|share|give|tell)\b.*\b(name|email|order\s*(id|number)|zip|account)\b"
LOOKUP_TOOL = r"^(get_|find_|lookup_|fetch_)"


def is_trivial(content: Column, calls: Column, turn_index: Column) -> Column:
    """Greetings, short requests for identity, and single look-ups (TRC-20)."""
    none = F.size(calls) == 0
    greeting = (turn_index == 0) & none & content.rlike(GREETING)
    ask = none & content.rlike(IDENTITY_REQUEST) & (F.length(content) < 200)
    lookup = (F.size(calls) == 1) & F.coalesce(calls[0]["name"].rlike(LOOKUP_TOOL), F.lit(False)) & (F.length(content) < 50)
    return greeting | ask | lookup


def trace_context(messages: DataFrame, chars: int = 6000, message_chars: int = 300) -> DataFrame:
    """Trace text for a judge: messages cut, the whole cut with a mark (TRC-21)."""
    line = F.struct("pos", F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.substring("content", 1, message_chars)).alias("t"))
    whole = messages.groupBy("trace").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]), "\n").alias("text"),
        F.max_by(F.substring("content", 1, 150), F.when((F.col("role") == "assistant") & (F.col("content") != ""), F.col("pos"))).alias("final_response"),
    )
    cut = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("\n... (truncated)"))).otherwise(F.col("text"))
    return whole.select("trace", cut.alias("context"), F.concat(F.lit("Final response: "), "final_response").alias("outcome"))


def select_pivots(rows: DataFrame, rating: str, key: list[str], threshold: float = 0.6, anchor_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows rated at or over the threshold, and max(1, floor(10 %)) pinned anchors of the rest (TRC-23).

    A missing rating counts as below.  The anchors are the first in pinned order
    up to a count taken from an aggregate; ranks are compared, not collected.
    """
    high = F.coalesce(F.col(rating) >= threshold, F.lit(False))
    below = rows.where(~high)
    n = below.count()
    anchors = below.orderBy(pinned(seed, *map(F.col, key)), *key).limit(max(1, int(n * anchor_fraction)) if n else 0)
    return rows.where(high).withColumn("kind", F.lit("pivot")).unionByName(anchors.withColumn("kind", F.lit("anchor")))


def unrated(rows: DataFrame, ratings: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose rating is not in the store (TRC-24)."""
    return rows.join(ratings, key, "left_anti")


def group_spans(spans: DataFrame) -> DataFrame:
    """Spans by root id: the root is the span that is its own root, else the first; children keep arrival order (TRC-16)."""
    ordered = F.array_sort(F.collect_list(F.struct("arrival", "span_id")))
    groups = spans.groupBy("root_span_id").agg(ordered.alias("s"))
    own = F.filter("s", lambda x: x["span_id"] == F.col("root_span_id"))
    root = F.coalesce(F.get(own, F.lit(0))["span_id"], F.col("s")[0]["span_id"])
    children = F.filter("s", lambda x: x["span_id"] != root)
    return groups.select("root_span_id", root.alias("root"), F.array_join(F.transform(children, lambda x: x["span_id"]), ",").alias("children"))


def pivot_category(rating: Column, pivot: float = 0.6, downstream: float = 0.3) -> Column:
    """pivot, downstream, trivial, or unrated without a rating (TRC-25)."""
    return F.when(rating >= pivot, "pivot").when(rating >= downstream, "downstream").when(rating.isNull(), "unrated").otherwise("trivial")


def pivot_summary(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Turns and their mean rating by category (TRC-25).  rows: rating."""
    return rows.groupBy(pivot_category(F.col("rating")).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("rating"), digits).alias("mean_rating"))
