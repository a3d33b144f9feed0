"""Queries that run as streams over events and return what they wrote."""

from __future__ import annotations

from ..streaming import streams as op
from .registry import query

DAY = "strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S')"


@query("str_01_tumbling", f"SELECT event_type, {DAY} AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str_01(spark, sf):
    return op.run_to_table(op.tumbling(op.event_stream(spark, sf)), "complete")


@query("str_02_sliding", "SELECT strftime(b - INTERVAL 1 DAY * k, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b FROM events), (VALUES (0), (1)) AS t(k) GROUP BY 1")
def str_02(spark, sf):
    return op.run_to_table(op.sliding(op.event_stream(spark, sf)), "complete")


@query("str_03_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def str_03(spark, sf):
    return op.run_to_table(op.sessions(op.event_stream(spark, sf)), "complete")


@query("str_04_first_seen", "SELECT user_id, event_type FROM events GROUP BY ALL")
def str_04(spark, sf):
    rows = op.first_seen(op.event_stream(spark, sf), ["user_id", "event_type"])
    return op.run_to_table(rows, "append").select("user_id", "event_type")


@query("ckp_05_quota_stream", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= CASE event_type WHEN 'view' THEN 40 WHEN 'click' THEN 25 ELSE 0 END")
def ckp_05(spark, sf):
    return op.accept_with_quotas(op.event_stream(spark, sf), {"view": 40, "click": 25}, ["event_id"]).select("event_type", "event_id")
