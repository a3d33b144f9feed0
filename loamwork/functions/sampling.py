"""Random-looking but pinned orders, exact quantiles, apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pinned(seed: int, *key: Column) -> Column:
    """A sort key that shuffles rows the same way in every engine and run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)))


def sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """The first n rows in pinned order: a top-n, so no full sort is shuffled."""
    return df.orderBy(pinned(seed, *map(F.col, key)), *key).limit(n)


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """Rows with their number, from 1, in a total order, without bringing them together.

    Rows are range-partitioned by the order and written; a row's number is its
    place in its partition and the sizes of the partitions before, of which
    there are as many as shuffle partitions.
    """
    from .greedy import cut

    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).select("__part", "__before")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.join(F.broadcast(before), "__part").withColumn(name, (place + F.col("__before")).cast("bigint")).drop("__part", "__before")


def running_totals(df: DataFrame, value: str) -> DataFrame:
    """Distinct values (v) with the number of rows up to each (upto); nulls are left out.

    Like numbered(): range partitions, and a sum over their totals only.
    """
    from .greedy import cut

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("rows"))
    rows = cut(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("part").agg(F.sum("rows").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size")).select("part", "before")
    own = F.sum("rows").over(Window.partitionBy("part").orderBy("v"))
    return rows.join(F.broadcast(before), "part").select("v", (own + F.col("before")).alias("upto"))


def exclusive_quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with q0, q1, ...: quantiles by the exclusive method, all in one pass over the distinct values.

    Rank p (n + 1), interpolated, clamped to the ends; null without values, the
    value itself where there is only one.
    """
    totals = running_totals(df, value)
    n = df.agg(F.count(value).alias("all"))
    low = [F.greatest(F.lit(1), F.least(F.col("all") - 1, F.floor(p * (F.col("all") + 1)))) for p in shares]
    reach = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    found = totals.join(F.broadcast(n)).groupBy("all").agg(*(reach(k).alias(f"lo{i}") for i, k in enumerate(low)), *(reach(F.least(F.col("all"), k + 1)).alias(f"hi{i}") for i, k in enumerate(low)))
    cuts = [F.col(f"lo{i}") + (p * (F.col("all") + 1) - low[i]) * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i, p in enumerate(shares)]
    whole = n.join(F.broadcast(found), "all", "left")
    return whole.select(*(c.alias(f"q{i}") for i, c in enumerate(cuts)))


def exclusive_quantile(df: DataFrame, value: str, p: float, by: list[str] | None = None) -> DataFrame:
    """Quantile by the exclusive method: rank p (n + 1), interpolated, clamped to the ends.

    Ranks come from counts per distinct value, so that the rows of a group meet
    only as sums.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy("__v")
    ranked = counts.withColumn("__hi", F.sum("__n").over(w)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    at = p * (F.col("__all") + 1)
    low = F.greatest(F.lit(1), F.least(F.col("__all") - 1, F.floor(at)))
    reach = lambda k: F.min(F.when(F.col("__hi") >= k, F.col("__v")))
    return ranked.groupBy(*by).agg(reach(low).alias("lo"), reach(F.least(F.col("__all"), low + 1)).alias("hi"), F.first(at - low).alias("w"))


def apportion(weights: dict[str, float], total: int) -> dict[str, int]:
    """Largest-remainder shares of a total; ties by weight, then by the later key."""
    clean = {k: max(0.0, w) for k, w in weights.items()}
    whole = sum(clean.values())
    if not clean or total <= 0 or whole <= 0:
        return dict.fromkeys(clean, 0)
    quota = {k: total * w / whole for k, w in clean.items()}
    out = {k: int(q) for k, q in quota.items()}
    order = sorted(clean, key=lambda k: (quota[k] - out[k], clean[k], k), reverse=True)
    for k in order[: total - sum(out.values())]:
        out[k] += 1
    return out
