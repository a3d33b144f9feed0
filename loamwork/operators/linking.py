"""Linking chunks into multi-hop anchors, and clusters of chunks into pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.greedy import cut
from ..functions.products import shared_scores
from ..functions.sets import jaccard, let
from ..functions.text import blank_split


def token_set(text: Column) -> Column:
    return F.array_distinct(blank_split(F.lower(text)))


def link_queries(parts: list[DataFrame], k: int = 10) -> DataFrame:
    """Queries (id, query, pos) of several kinds, first kind first, one of each, at most k a chunk (LNK-01)."""
    union = parts[0].select("id", "query", F.lit(0).alias("kind"), "pos")
    for n, p in enumerate(parts[1:], 1):
        union = union.union(p.select("id", "query", F.lit(n), "pos"))
    once = union.where(F.trim("query") != "").groupBy("id", F.lower("query").alias("q")).agg(F.min(F.struct("kind", "pos", "query")).alias("s"))
    w = Window.partitionBy("id").orderBy("s.kind", "s.pos", "q")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", F.col("s.query").alias("query"), "rank")


def fallback_query(text: Column, chars: int = 120) -> Column:
    """The first sentence, cut (LNK-02)."""
    return F.substring(F.trim(F.regexp_extract(text, r"^([^.!?]*)", 1)), 1, chars)


def longest_capitalised(text: Column) -> Column:
    """The longest run of capitalised words, the first of equals (LNK-02)."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{Lu}[\p{Ll}]+(?: \p{Lu}[\p{Ll}]+)*)"), F.lit(1))
    longest = lambda a, top: F.get(F.filter(a, lambda r: F.length(r) == top), F.lit(0))
    return let(runs, lambda a: let(F.array_max(F.transform(a, F.length)), lambda top: longest(a, top)))


def candidates(hits: DataFrame, chunks: DataFrame, used: DataFrame, least: int = 400, primaries: DataFrame | None = None) -> DataFrame:
    """Hits (pid, id, score) that can be linked: another chunk and file, long enough, unused (LNK-03).

    primaries (pid), where given, are few: their texts are broadcast, so that
    the candidates' texts are not shuffled once per primary.  The sets of words
    (pw, w) are made once per text, before candidates and primaries meet.
    """
    p = chunks.select(F.col("id").alias("pid"), F.col("file").alias("pfile"), F.col("text").alias("ptext"), token_set(F.col("text")).alias("pw"))
    if primaries is not None:
        p = F.broadcast(p.join(F.broadcast(primaries), "pid", "left_semi"))
    rows = hits.where("pid <> id").groupBy("pid", "id").agg(F.max("score").alias("score"))
    rows = rows.join(chunks.where(F.length("text") >= least).withColumn("w", token_set(F.col("text"))), "id")
    return rows.join(p, "pid").where("file <> pfile").join(used, "id", "left_anti")


def coherent(rows: DataFrame, low: float = 0.15, high: float = 0.55) -> DataFrame:
    """Candidates whose words overlap the primary's enough, but not too much (LNK-04)."""
    overlap = jaccard(F.col("pw"), F.col("w")) if "pw" in rows.columns else jaccard(token_set(F.col("ptext")), token_set(F.col("text")))
    return rows.withColumn("overlap", overlap).where(F.col("overlap").between(low, high))


def ranked(rows: DataFrame, bonus: Column, entity_ratio: Column, digits: int = 6) -> DataFrame:
    """Composite score: .4 search, .3 overlap, .3 entities, and a bonus (LNK-05)."""
    best = F.max("score").over(Window.partitionBy("pid"))
    base = 0.4 * F.when(best > 0, F.col("score") / best).otherwise(0.0) + 0.3 * F.col("overlap") + 0.3 * entity_ratio
    rows = rows.withColumn("composite", F.round((1 - bonus) * base + bonus, digits))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("composite"), "id")))


def diverse(rows: DataFrame, k: int = 3, limit: float = 0.55, pool: int = 20) -> DataFrame:
    """Greedy pick in rank order: skip what overlaps an earlier pick too much (LNK-06).

    Equal token sets overlap whole, so the first of each stands for all; empty
    sets overlap nothing and each stands for itself.  A round folds the *pool*
    best that are left of a primary into its picks; the next drops what they
    rule out and goes on, until k are picked or no candidate is left.
    """
    all_ = rows.select("pid", "rank", "id", token_set(F.col("text")).alias("w"))
    same = F.when(F.size("w") > 0, F.sha2(F.to_json(F.array_sort("w")), 256)).otherwise(F.concat(F.lit("empty "), F.col("rank").cast("string")))
    first = F.min_by(F.struct("id", "w"), "rank")
    once = all_.withColumn("same", same).groupBy("pid", "same").agg(F.min("rank").alias("rank"), first.alias("s"))
    left = cut(once.select("pid", F.struct("rank", "s.id", "s.w").alias("c")))
    kind = left.schema["c"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    near = lambda a, c: F.exists(a, lambda p: jaccard(p["w"], c["w"]) > limit)
    picks = cut(left.select("pid").distinct().withColumn("picked", none))
    while not left.isEmpty():
        best = F.row_number().over(Window.partitionBy("pid").orderBy("c.rank"))
        some = left.withColumn("n", best).where(F.col("n") <= pool).groupBy("pid").agg(F.array_sort(F.collect_list("c")).alias("cs"))
        fold = F.aggregate("cs", "picked", lambda a, c: F.when((F.size(a) >= k) | near(a, c), a).otherwise(F.concat(a, F.array(c))))
        step = cut(picks.join(some.select("pid", "cs"), "pid", "left").withColumn("cs", F.coalesce("cs", none)).select("pid", fold.alias("picked"), F.when(F.size("cs") > 0, F.get("cs", F.size("cs") - 1)["rank"]).alias("seen")))
        picks = step.select("pid", "picked")
        open_ = step.where((F.size("picked") < k) & F.col("seen").isNotNull())
        left = cut(left.join(open_, "pid").where((F.col("c.rank") > F.col("seen")) & ~near(F.col("picked"), F.col("c"))).select("pid", "c"))
    return picks.select("pid", F.posexplode("picked").alias("place", "c")).select("pid", "place", F.col("c.id").alias("id"))


def date_rerank(rank: Column, n: Column, days: Column, max_days: Column, digits: int = 6) -> Column:
    """.7 rank + .3 distance in days (LNK-08)."""
    place = F.when(n > 1, 1 - (rank - 1) / (n - 1)).otherwise(1.0)
    return F.round(0.7 * place + 0.3 * F.when(max_days > 0, days / max_days).otherwise(0.0), digits)


def gap_score(gap: Column) -> Column:
    """Nearer of the gaps 2 to 5 in a file; others nought (LNK-09)."""
    return F.when(gap.between(2, 5), 5 - gap + 1).otherwise(0)


def graph_scores(edges: DataFrame, quality: DataFrame, primaries: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """Shared and new entity weight of the chunks that share an entity with a primary (LNK-11).

    edges (name, id), quality (name, q; a row per name), primaries (id; by
    default all chunks).  Pairs of few primaries come from an equi-join on the
    entity, of their edges with all; those of all chunks from products of blocks,
    for a chunk pair shares many entities.  Entities are kept to the discriminative
    band beforehand.
    """
    known = edges.join(quality, "name", "left").withColumn("q", F.coalesce("q", F.lit(0.5)))
    if primaries is None:
        return shared_scores(cut(known.select("name", "id", "q")), digits)
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,9)")).cast("double")  # noqa: E731  whatever the order
    sizes = known.groupBy("id").agg(F.count("*").alias("n"), exact("q").alias("all"))
    left = known.join(primaries, "id", "left_semi").select("name", "id", "q")
    pairs = left.alias("x").join(known.alias("y"), (F.col("x.name") == F.col("y.name")) & (F.col("x.id") != F.col("y.id")))
    shared = pairs.groupBy(F.col("x.id").alias("pid"), F.col("y.id").alias("id")).agg(exact("x.q").alias("s"))
    p = sizes.select(F.col("id").alias("pid"), F.col("n").alias("pn"))
    rows = shared.join(p, "pid").join(sizes, "id")
    return rows.select("pid", "id", F.round(F.col("s") / F.col("pn"), digits).alias("shared"), F.round((F.col("all") - F.col("s")) / F.col("n"), digits).alias("new"))


def confidence(found: Column, requested: Column) -> Column:
    """Found of requested, at most 1 (LNK-17)."""
    return F.when(requested > 0, F.least(F.lit(1.0), found / requested)).otherwise(0.0)


def rollout_queries(text: Column) -> Column:
    """Queries of search calls in a rollout's text (LNK-14)."""
    calls = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    return F.filter(F.transform(calls, lambda c: F.get_json_object(c, "$.arguments.query")), lambda q: q.isNotNull() & (q != ""))


def evidence_chain(text: Column) -> Column:
    """What stands in the evidence tag (LNK-14)."""
    return F.trim(F.regexp_extract(text, r"(?is)<evidence_chain>(.*?)</evidence_chain>", 1))


def clusters(edges: DataFrame, stats: DataFrame, quality: float = 0.75, max_df: float = 0.4, least: int = 3, most: int = 50) -> DataFrame:
    """Entities that make a page: good, not too common, with enough chunks (WIK-01).  stats: name, df, q."""
    good = stats.where((F.col("q") > quality) & (F.col("df") < max_df)).select("name")
    sizes = edges.join(good, "name").groupBy("name").agg(F.count_distinct("id").alias("n_chunks"))
    return sizes.where(F.col("n_chunks").between(least, most))


def round_robin(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows taken in turn from the files, in the files' order of appearance (WIK-03)."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("id"))
    first = rows.groupBy("file").agg(F.min("id").alias("first"))
    return rows.withColumn("round", place).join(first, "file").orderBy("round", "first", "id").limit(k).select("id", "file", "round")


def cross_links(pages: DataFrame) -> DataFrame:
    """Pages whose text names another page's title (WIK-05).  pages: title, text; few by definition."""
    a, b = pages.alias("a"), pages.select(F.col("title").alias("to")).alias("b")
    return a.join(F.broadcast(b), F.expr("contains(lower(a.text), lower(b.to)) AND a.title <> b.to")).select(F.col("a.title").alias("title"), "to")


def within_budget(pages: DataFrame, budget: int, chars_per_token: int = 4, least: int = 100) -> DataFrame:
    """Pages by score while their tokens fit; the one that does not is cut if enough is left (WIK-06).

    pages: pid, title, n_chars, score; the running sum stays within a primary.
    """
    tokens = F.floor(F.col("n_chars") / chars_per_token)
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("pid").orderBy(F.desc("score"), "title").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pages.withColumn("tokens", tokens).withColumn("before", before).withColumn("left", budget - F.col("before"))
    rows = rows.where((F.col("tokens") <= F.col("left")) | (F.col("left") > least))
    return rows.select("pid", "title", F.least("tokens", "left").alias("used"), (F.col("tokens") > F.col("left")).alias("cut")).where("used > 0")


def mode_rules(mode: Column, least: Column) -> Column:
    """struct(needs_date, same_file, coherence) of a reasoning mode (LNK-07)."""
    low = F.when(mode == "inference", F.greatest(0.5 * least, F.lit(0.05))).otherwise(least)
    return F.struct((mode == "temporal").alias("needs_date"), (mode == "sequential").alias("same_file"), low.alias("coherence"))


def agent_confidence(fulfilled: Column, survived: Column, chain: Column) -> Column:
    """.4 fulfilment + .3 survival + .3 chain: 1 whole, .3 partial, 0 none (LNK-13)."""
    linked = F.when(chain == "whole", 1.0).when(chain == "partial", 0.3).otherwise(0.0)
    return 0.4 * fulfilled + 0.3 * survived + 0.3 * linked


def link_counters(log: DataFrame) -> DataFrame:
    """Queries tried, results found and connections made, by type (PRF-24).  log: type, results."""
    return log.groupBy("type").agg(F.count("*").alias("queries"), F.sum("results").alias("results"), F.count(F.when(F.col("results") > 0, 1)).alias("connected"))


def page_scores(pages: DataFrame, names: DataFrame, anchors: DataFrame) -> DataFrame:
    """What a page is worth to a primary: pid, title, score (WIK-06).

    pages: title, ids (chunks that it was made of); names: title, name; anchors:
    pid, id, text, primary (true for the primary, false for its secondaries).  A
    name of three characters or more in the primary counts 2, in a secondary 1;
    a page made of the primary 3 more, of a secondary 1.5.  Names stand anywhere
    in a text, so each text meets the names once; pages worth nothing are left out.
    """
    low = names.select("title", F.lower("name").alias("name")).where(F.length("name") >= 3).distinct()
    text = anchors.select("pid", "primary", F.lower("text").alias("text"))
    held = text.join(low, F.expr("contains(text, name)")).select("pid", "title", F.when(F.col("primary"), 2.0).otherwise(1.0).alias("s"))
    made = anchors.join(pages.select("title", F.explode("ids").alias("id")), "id").select("pid", "title", F.when(F.col("primary"), 3.0).otherwise(1.5).alias("s"))
    return held.union(made).groupBy("pid", "title").agg(F.sum("s").alias("score"))


def linked_candidates(scores: DataFrame, pairs: DataFrame, edges: DataFrame, chunks: DataFrame, *, least: int = 400, near: float = 0.55, digits: int = 6, primaries: DataFrame | None = None) -> DataFrame:
    """Candidates of primaries by shared and new entities, proximity and file: pid, id, score (LNK-11).

    scores: pid, id, shared, new (graph_scores); pairs: a, b, n_chunks
    (co_occurrence); edges: name, id; chunks: id, file, text.  Proximity is the
    mean co-occurrence of the two chunks' different entities, of a tenth of the
    largest, at most 1.  Texts of fewer than *least* characters and those whose
    words overlap the primary's by more than *near* are left out.

    primaries (pid), where given, are few and hold all pids of scores: their
    sets of words are broadcast, so that no text is shuffled.  A primary's
    co-occurrences are summed per entity before candidates meet them.
    """
    pairs = cut(pairs.select("a", "b", "n_chunks"))
    both = pairs.union(pairs.select("b", "a", "n_chunks"))
    peak = pairs.agg(F.greatest(F.coalesce(F.max("n_chunks"), F.lit(0)) * 0.1, F.lit(1.0)).alias("peak"))
    p = chunks.select(F.col("id").alias("pid"), F.col("file").alias("pfile"), token_set(F.col("text")).alias("pw"))
    long = chunks.where(F.length("text") >= least).select("id", "file", token_set(F.col("text")).alias("w"))
    apart = (F.col("file") != F.col("pfile")).cast("int").alias("apart")
    if primaries is None:
        rows = scores.join(long, "id").join(p, "pid").where(jaccard(F.col("pw"), F.col("w")) <= near).select("pid", "id", "shared", "new", apart)
    else:
        few = F.broadcast(p.join(F.broadcast(primaries), "pid", "left_semi"))
        far = long.crossJoin(few).where("id <> pid").where(jaccard(F.col("pw"), F.col("w")) <= near).select("pid", "id", apart)
        rows = scores.join(far, ["pid", "id"])
    rows = cut(rows)
    mine = edges.join(rows.select(F.col("pid").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("pid"), "name")
    reach = both.join(mine.withColumnRenamed("name", "a"), "a").select("pid", F.col("b").alias("name"), "n_chunks", F.lit(0).alias("own"))
    weights = cut(reach.union(mine.select("pid", "name", F.lit(0), F.lit(1))).groupBy("pid", "name").agg(F.sum("n_chunks").alias("c"), F.sum("own").alias("own")))
    sizes = edges.groupBy("id").agg(F.count("*").alias("n"))
    met = edges.join(weights, "name").groupBy("pid", "id").agg(F.sum("c").alias("c"), F.sum("own").alias("own"))
    met = met.join(sizes.select(F.col("id").alias("pid"), F.col("n").alias("pn")), "pid").join(sizes, "id").withColumn("k", F.col("pn") * F.col("n") - F.col("own"))
    mean = F.when(F.col("k") > 0, F.col("c") / F.col("k"))
    close = met.join(F.broadcast(peak)).select("pid", "id", F.least(F.lit(1.0), mean / F.col("peak")).alias("close"), "k").where("k > 0").drop("k")
    total = 0.3 * F.col("shared") + 0.3 * F.col("new") + 0.2 * F.coalesce("close", F.lit(0.0)) + 0.2 * F.col("apart")
    return rows.join(close, ["pid", "id"], "left").select("pid", "id", F.round(total, digits).alias("score"))


def pattern_queries(rows: DataFrame, patterns: list[str], most: int = 2) -> DataFrame:
    """The first hits of each pattern in a text as queries: id, query, pos (LNK-01).  rows: id, text."""

    def hits(n: int, pattern: str) -> Column:
        first = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), 1, most)
        return F.transform(first, lambda x, i: F.struct(x.alias("query"), (i + n * most).alias("pos")))

    found = [hits(n, p) for n, p in enumerate(patterns)]
    return rows.select("id", F.explode(F.concat(*found)).alias("q")).select("id", "q.query", "q.pos").where("query <> ''")


def pair_queries(rows: DataFrame, most: int = 4) -> DataFrame:
    """Pairs of a chunk's first entities as queries: id, query, pos (LNK-01).  rows: id, names (in order)."""
    first = rows.select("id", F.slice("names", 1, most).alias("n"))
    pairs = F.flatten(F.transform("n", lambda a, i: F.transform(F.slice("n", i + 2, most), lambda b: F.concat_ws(" ", a, b))))
    return first.select("id", F.posexplode(pairs).alias("pos", "query")).select("id", "query", "pos")
