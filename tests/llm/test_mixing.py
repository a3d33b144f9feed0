import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamwork.llm import mixing


def test_copies_follow_the_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "b").otherwise("c").alias("source"))
    got = mixing.mix(docs, weights={"a": 1, "b": 1, "c": 2}, total=8000).groupBy("source").count().collect()
    want = {"a": 2000, "b": 2000, "c": 4000}
    for r in got:
        assert abs(r["count"] - want[r["source"]]) < 5 * math.sqrt(want[r["source"]]) * 3


def test_counts_are_poisson(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    copies = Counter(r.doc_id for r in mixing.mix(docs, total=30_000).select("doc_id").collect())
    tally = Counter(copies.get(i, 0) for i in range(20_000))
    for k in range(6):
        want = 20_000 * math.exp(-1.5) * 1.5**k / math.factorial(k)
        assert abs(tally[k] - want) < 5 * math.sqrt(want)


def test_large_rates_are_summed(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    got = mixing.mix(docs, total=5 * 1300.0).groupBy("doc_id").count().collect()
    assert len(got) == 5 and len({r["count"] for r in got}) > 1
    assert all(abs(r["count"] - 1300) < 200 for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "x", 5), (1, None, "x", 5), (None, "s", "y", 6), (2, "s", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, copy int")
    got = mixing.mix(docs, total=200).collect()
    assert set(got[0].asDict()) == {"doc_id", "source", "text", "copy", "rate", "shuffle_key"}
    same = [Counter(r.copy for r in got if r.doc_id == 1)]
    assert set(same[0].values()) == {2}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, weights={}).count() == 0


def test_the_order_does_not_follow_the_sources(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id(), "source").count().collect()]
    assert max(sizes) < 1.6 * min(sizes)
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_a_source_table_that_is_not_broadcast(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("source"))
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


@pytest.mark.parametrize("total", [0, 0.0])
def test_no_rows_wanted(spark, total):
    docs = spark.createDataFrame([(1, "s")], "doc_id bigint, source string")
    assert mixing.mix(docs, total=total).count() == 0
