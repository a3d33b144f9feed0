"""Order-dependent selection over candidate pairs, without any step on the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut a plan's lineage by a table in spark.checkpoint.dir (a temporary folder only in local mode)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loamwork-")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_first(pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Which members of matching pairs (a < b) stay if each is dropped that matches an earlier one that stays.

    Returns (id, kept) for the ids in pairs.  A round decides all ids whose
    earlier matches are decided, so the rounds follow the longest chain of
    matches, not the rows.
    """
    left = cut(pairs.select("a", "b").where("a < b").distinct())
    done: list[DataFrame] = []
    open_ids = cut(left.select(F.col("a").alias("id")).union(left.select("b")).distinct())
    for _ in range(max_rounds):
        if open_ids.isEmpty():
            break
        blocked = left.select(F.col("b").alias("id")).distinct()
        fresh = cut(open_ids.join(blocked, "id", "left_anti"))
        dropped = cut(left.join(fresh.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        done += [fresh.withColumn("kept", F.lit(True)), dropped.withColumn("kept", F.lit(False))]
        decided = fresh.union(dropped)
        left = left.join(decided.withColumnRenamed("id", "a"), "a", "left_anti").join(decided.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        open_ids, left = cut(open_ids.join(decided, "id", "left_anti")), cut(left)
    else:
        raise RuntimeError(f"no decision in {max_rounds} rounds")
    if not done:
        return open_ids.withColumn("kept", F.lit(True))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def leaders(pairs: DataFrame) -> DataFrame:
    """(id, leader) for the ids in matching pairs: each joins its earliest leader; leaders are what keep_first keeps."""
    state = cut(keep_first(pairs))
    lead = state.where("kept").select(F.col("id").alias("a"))
    follow = pairs.join(lead, "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    rows = state.where("NOT kept").join(follow, "id").select("id", "leader")
    return rows.union(state.where("kept").select("id", F.col("id").alias("leader")))


def components(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, root) for the ids in pairs: the smallest id reachable, by minimum labels and pointer jumping."""
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = label.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = label.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = cut(step.join(jump, "root", "left").select("id", F.least("root", F.coalesce("far", "root")).alias("root"), "old"))
        label = step.select("id", "root")
        if step.where("root <> old").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
