import datetime

import pytest

from loamwork.streaming import streams as op


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(hours=i), i % 3, "view" if i % 2 else "click", float(i), "{}") for i in range(60)]
    path = tmp_path_factory.mktemp("stream")
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").toPandas().to_parquet(f"{path}/events.parquet", coerce_timestamps="us")
    return str(path)


def test_quota_is_never_exceeded(spark, folder):
    got = op.accept_with_quotas(op.event_stream(spark, folder), {"view": 5}, ["event_id"]).collect()
    assert sorted(r.event_id for r in got) == [1, 3, 5, 7, 9]


def test_windows_cover_all_events(spark, folder):
    for build in (op.tumbling, op.sessions):
        rows = op.run_to_table(build(op.event_stream(spark, folder)), "complete").collect()
        assert sum(r.n for r in rows) == 60
    assert sum(r.n for r in op.run_to_table(op.sliding(op.event_stream(spark, folder)), "complete").collect()) == 120


def test_first_seen_is_one_row_per_key(spark, folder):
    rows = op.run_to_table(op.first_seen(op.event_stream(spark, folder), ["user_id", "event_type"]), "append")
    assert rows.count() == 6
