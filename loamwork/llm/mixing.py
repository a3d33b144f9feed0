"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, parallelism

#: A rate above this is drawn as a sum of equal smaller ones, for exp(-rate) must stay above 0.
LARGEST = 500
#: Source tables up to so many rows are broadcast; larger ones are joined by a shuffle.
FEW_SOURCES = 10_000


def source_rates(docs: DataFrame, *, source_col: str = "source", weights: Mapping[str, float] | None = None, temperature: float = 0.5, total: float | None = None) -> DataFrame:
    """Per source: n, rate (mean copies of a row), parts and cdf (see replicate).

    The target weight of a source is weights[source] (0 where it is missing) or,
    without weights, n ** temperature; weights are made to sum to 1.  The rate
    gives *total* rows in the mean, by default as many as there are.  A null
    source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()] or [("", 0.0)], "s string, w double")
        counts = counts.join(F.broadcast(given), F.col("source") == F.col("s"), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    else:
        counts = counts.select("source", "n", F.pow(F.col("n").cast("double"), F.lit(float(temperature))).alias("w"))
    counts = materialise(counts, "sources")
    whole = counts.agg(F.sum("w").alias("sum_w"), F.sum("n").alias("sum_n"))
    wanted = F.lit(float(total)) if total is not None else F.col("sum_n").cast("double")
    rated = counts.join(F.broadcast(whole)).withColumn("rate", F.when(F.col("sum_w") > 0, F.col("w") / F.col("sum_w") * wanted / F.col("n")).otherwise(0.0))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST)).cast("int"))
    rated = rated.withColumn("part_rate", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("part_rate") + 12 * F.sqrt("part_rate") + 30).cast("int")
    zero = F.exp(-F.col("part_rate"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all")),
        lambda a, k: F.struct((a["p"] * F.col("part_rate") / k).alias("p"), (a["c"] + a["p"] * F.col("part_rate") / k).alias("c"), F.concat(a["all"], F.array(a["c"] + a["p"] * F.col("part_rate") / k)).alias("all")),
        lambda a: a["all"],
    )
    return materialise(rated.select("source", "n", "rate", "parts", cdf.alias("cdf")), "rates")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float] | None = None, temperature: float = 0.5, total: float | None = None, seed: int = 29) -> DataFrame:
    """Replicate rows so that the sources come in target proportions, in random order.

    A row's number of copies inverts the Poisson distribution with its source's
    rate at a uniform number made of md5(seed, id, part): the count of values of
    the distribution function that do not exceed it.  It depends on nothing but
    id, seed and rate, so a task that runs again makes the same copies.  Rows
    are replicated by explode and dealt to partitions by a hash of (seed, id,
    copy), sorted within; neither depends on the source, so a source with a
    third of all rows loads no task more than others.

    Returns the input's columns with ``copy`` (from 1), ``rate`` (rounded to 6
    places) and ``shuffle_key`` (bigint; the order within a partition); columns
    of these names in the input are replaced.  Rows with no copy are left out.
    A null source is a source of its own; a row with a null id is
    drawn by a hash of its other columns; rows with equal ids have equally many copies; an empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, source_col=source_col, weights=weights, temperature=temperature, total=total)
    kept = [c for c in docs.columns if c not in ("copy", "rate", "shuffle_key")]
    source, rate, parts, cdf, u, n = (fresh(docs, f"__{name}") for name in ("source", "rate", "parts", "cdf", "u", "n"))
    rates = rates.select(F.col("source").alias(source), F.col("rate").alias(rate), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    if rates.count() <= FEW_SOURCES:
        rates = F.broadcast(rates)
    others = [F.col(c) for c in kept if c != id_col]
    own = F.sha2(F.to_json(F.struct(*others, F.lit(1).alias(fresh(docs, "__one")))), 256)
    key = F.coalesce(F.col(id_col).cast("string"), own)

    def draw(part):
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key, part.cast("string"))), 1, 13)
        return F.conv(digits, 16, 10).cast("double") / float(1 << 52)

    one = F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    many = F.aggregate(F.sequence(F.lit(0), F.col(parts) - 1), F.lit(0), lambda a, k: a + F.size(F.filter(cdf, lambda c: c <= draw(k))))
    rows = docs.select(*kept).join(rates, F.col(source_col).cast("string").eqNullSafe(F.col(source)))
    rows = rows.withColumn(u, draw(F.lit(0))).withColumn(n, F.when(F.col(parts) == 1, one).otherwise(many))
    rows = rows.where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    mixed = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, F.col("copy").cast("string")))
    rows = rows.withColumn("shuffle_key", F.conv(F.substring(mixed, 1, 15), 16, 10).cast("bigint"))
    rows = rows.select(*kept, "copy", F.round(rate, 6).alias("rate"), "shuffle_key")
    return rows.repartition(parallelism(spark), "shuffle_key").sortWithinPartitions("shuffle_key")


#: DuckDB SQL for mix() over documents with its defaults.
ORACLE = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source
), rates AS (
  SELECT source, w / sum(w) OVER () * sum(n) OVER ()::DOUBLE / n AS rate FROM counts
), cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)
), drawn AS (
  SELECT *, ('0x' || substr(md5('29|' || doc_id || '|0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents
), counted AS (
  SELECT d.doc_id, c.rate, count(*) AS n
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u GROUP BY ALL
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, k.copy::INTEGER AS copy, round(c.rate, 6) AS rate,
  ('0x' || substr(md5('29-order|' || d.doc_id || '|' || k.copy), 1, 15))::BIGINT AS shuffle_key
FROM documents d JOIN counted c USING (doc_id), LATERAL (SELECT unnest(generate_series(1, c.n)) AS copy) k
"""
