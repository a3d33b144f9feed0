"""The corpus pipeline: raw documents to packed training sequences.

Each stage reads all that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from loamwork.llm import langid, mixing, packing, pii, simhash
from loamwork.llm.common import fresh, materialise
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no letters, or too narrow a margin."""
    model, mark = langid.learn(docs), fresh(docs, "__found")
    found = docs.withColumn(mark, langid.identify(model, F.col("text")))
    return found.where(~F.col(f"{mark}.rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate component: that with the smallest doc_id.

    A null doc_id counts as the largest.  Of several rows with the smallest
    doc_id one stays, the first by fingerprint and hash of the text; of rows
    that are alike in that too, one.  Rows are told apart by doc_id and text,
    so an id that several texts share loses none of them to another component.
    Which rows stay is decided on ids, fingerprints and hashes; texts meet
    these in one semi-join.
    """
    h0, h1 = F.xxhash64(F.lit(0), "text"), F.xxhash64(F.lit(1), "text")
    rows = docs.select("doc_id", "text", F.struct("doc_id", h0.alias("h0"), h1.alias("h1")).alias("row"))
    found = simhash.near_duplicates(rows, id_col="row")
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", "fingerprint", "row.h0", "row.h1")
    kept = found.groupBy("component_key").agg(F.min_by("row", order).alias("row"))
    copies = found.groupBy("row").agg(F.count("*").alias("copies"))
    kept = materialise(kept.join(copies, "row").select("row.*", "copies"), "kept")

    def chosen(some: DataFrame) -> DataFrame:
        some = some.select(F.col("doc_id").alias("i"), F.col("h0").alias("a"), F.col("h1").alias("b"))
        return docs.join(some, F.col("doc_id").eqNullSafe(F.col("i")) & (h0 == F.col("a")) & (h1 == F.col("b")), "left_semi")

    return chosen(kept.where("copies = 1")).union(chosen(kept.where("copies > 1")).dropDuplicates(["doc_id", "text"]))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; n_chars follows the text."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources weigh as the square root of their size, in random order."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 2048."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_pseudonyms", replace_personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express compression, suffix hashes or tokenizers; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
