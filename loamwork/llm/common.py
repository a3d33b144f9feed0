"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  A folder of our own is used
    only where that is unset and the master is local, as in tests.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dirs.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="loamwork-"))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of *df*: write it as Parquet to the shared folder, read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame | None) -> None:
    """Delete the files of materialised tables that no later step reads."""
    for df in frames:
        if df is None:
            continue
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that *df* does not have, whatever the case: *name* and underscores."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches() -> None:
    """Have Spark hand texts to Python in batches of few MB, however long they are.

    The session's settings are only lowered, never raised.  Each batch is held
    by the JVM and by Python, in every running task.
    """
    spark = SparkSession.active()
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return a task's freed memory to the system, for Python workers live on and are used again."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parallelism(spark: SparkSession) -> int:
    """Tasks that a shuffle of this session has."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """Rows that a model may learn from: a known doc_id that is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)
