"""Streams: windows with watermarks, deduplication, quota acceptance in micro-batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's Parquet file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def work_dir(spark: SparkSession) -> str:
    """A folder for a run's checkpoint and output, below spark.checkpoint.dir; one of our own only where that is unset and the master is local."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loamwork-stream-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is and return its result: the last state (complete) or all rows (append)."""
    spark = stream.sparkSession
    home = work_dir(spark)

    def put(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder, so the sink is idempotent.
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    out = spark.read.option("basePath", f"{home}/out").parquet(f"{home}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == (last or 0))
    return out.drop("batch")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per type and window."""
    w = F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user, parted by gaps."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """One row per key within the watermark: incremental deduplication (QAF-24 as a stream)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def accept_with_quotas(stream: DataFrame, quotas: dict[str, int], order: list[str]) -> DataFrame:
    """Accept rows per type while quotas last, over micro-batches (CKP-05).

    The state between batches is what was accepted, one count per type, read
    from the sink itself; a replayed batch finds only earlier batches' rows.
    """
    from pyspark.sql import Window

    spark = stream.sparkSession
    home = work_dir(spark)
    limits = spark.createDataFrame(list(quotas.items()), "event_type string, quota int")

    def put(batch: DataFrame, batch_id: int) -> None:
        left = limits
        if batch_id:
            done = spark.read.option("basePath", f"{home}/out").parquet(f"{home}/out").where(F.col("batch") < batch_id).groupBy("event_type").agg(F.count("*").alias("used"))
            left = limits.join(done, "event_type", "left").select("event_type", (F.col("quota") - F.coalesce("used", F.lit(0))).alias("quota"))
        ranked = batch.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(*order)))
        kept = ranked.join(F.broadcast(left), "event_type").where("place <= quota").drop("place", "quota")
        kept.write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

    stream.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.option("basePath", f"{home}/out").parquet(f"{home}/out").drop("batch")
