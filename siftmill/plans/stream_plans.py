"""Streams over the event table, each checked against its batch twin on what is closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.plans.concept_sql import K
from siftmill.plans.registry import query
from siftmill.sources.tables import table
from siftmill.streaming import state, windows
from siftmill.streaming.runner import event_stream, run_to_table, utc_instant

US = "epoch_us(ts)"
# The watermark after the last batch: the newest event time in milliseconds minus a day.
WM = f"wm AS (SELECT (max({US}) // 1000) * 1000 - 86400000000 AS wm FROM events)"
SESS = f"""e AS (SELECT *, {US} AS us, CASE WHEN {US} - lag({US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM e),
s AS (SELECT user_id, min(us) AS start_us, max(us) + 14400000000 AS end_us, count(*) AS calls, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS reads, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS writes FROM g GROUP BY user_id, sess)"""


@query("session_stream", "STR2 STR5", f"WITH {WM}, {SESS} SELECT user_id, start_us, end_us, calls, reads, writes FROM s, wm WHERE end_us <= wm")
def session_stream(spark, d):
    return run_to_table(windows.session_counts(event_stream(spark, d), "user_id"), "sessions")


@query("session_batch", "STR2 STR5", f"WITH {SESS} SELECT * FROM s")
def session_batch(spark, d):
    batch = table(spark, d, "events").withColumn("event_time", utc_instant(F.col("ts")))
    return windows.session_counts(batch, "user_id")


@query(
    "daily_counts_stream", "STR3",
    f"""WITH {WM} SELECT {US} // 86400000000 AS day, event_type, count(*) AS ops, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents, CAST(sum({K}) AS BIGINT) AS k_sum FROM events, wm
WHERE ({US} // 86400000000 + 1) * 86400000000 <= wm GROUP BY ALL""",
)
def daily_counts_stream(spark, d):
    return run_to_table(windows.bucket_counts(event_stream(spark, d), "event_type"), "daily")


@query(
    "failure_share_stream", "STR6",
    f"""WITH {WM}, d AS (SELECT {US} // 86400000000 AS day, 'task-' || (user_id % 4) AS task, event_type FROM events), w AS (SELECT unnest(range(day - 13, day + 1)) AS first_day, task, event_type FROM d)
SELECT first_day, task, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) AS share FROM w, wm WHERE (first_day + 14) * 86400000000 <= wm GROUP BY ALL""",
)
def failure_share_stream(spark, d):
    task = F.concat(F.lit("task-"), F.col("user_id") % 4)
    return run_to_table(windows.sliding_share(event_stream(spark, d), task, F.col("event_type") == "error"), "failures")


DELTA = "CASE event_type WHEN 'purchase' THEN 5 WHEN 'view' THEN 2 WHEN 'error' THEN -15 WHEN 'click' THEN -8 ELSE 0 END"


@query(
    "rule_counter_stream", "STR4 WIN7",
    f"""WITH e AS (SELECT user_id, CAST({DELTA} AS BIGINT) AS delta, ts, event_id FROM events) SELECT user_id, count(*) AS seen, count(*) FILTER (WHERE delta > 0) AS confirmed, count(*) FILTER (WHERE delta < 0) AS dismissed,
 list_reduce(list(delta ORDER BY ts, event_id), lambda a, x: least(95, greatest(10, a + x)), CAST(50 AS BIGINT)) AS trust FROM e GROUP BY user_id""",
)
def rule_counter_stream(spark, d):
    kind = F.col("event_type")
    delta = F.when(kind == "purchase", 5).when(kind == "view", 2).when(kind == "error", -15).when(kind == "click", -8).otherwise(0)
    updates = run_to_table(state.running_counters(event_stream(spark, d).withColumn("delta", delta), "user_id"), "counters")
    return state.latest(updates, "user_id")


@query(
    "changed_file_stream", "STR1",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, {US} AS us, props FROM events), r(user_id, us) AS (SELECT user_id, min(us) FROM e GROUP BY user_id
 UNION ALL SELECT r.user_id, min(e.us) FROM r JOIN e ON e.user_id = r.user_id AND e.us >= r.us + 14400000000 GROUP BY r.user_id),
p AS (SELECT e.props FROM r JOIN e ON e.user_id = r.user_id AND e.us = r.us)
SELECT CASE WHEN regexp_matches(props, '"k": 9[0-9]') THEN 'BLOCK' ELSE 'PASS' END AS status, count(*) AS files, count(*) FILTER (WHERE regexp_matches(props, '"k": 9[0-9]')) AS critical, count(*) FILTER (WHERE regexp_matches(props, '"k": 8[0-9]')) AS high FROM p GROUP BY 1""",
)
def changed_file_stream(spark, d):
    # Four hours stand in for half a second: the events of a user are hours apart.
    passed = state.debounced(event_stream(spark, d), "user_id", wait_ms=4 * 3600 * 1000)
    checked = state.file_status(passed, F.col("content").rlike('"k": 9[0-9]'), F.col("content").rlike('"k": 8[0-9]'))
    return run_to_table(checked, "changes").groupBy("status").agg(F.count("*").alias("files"), F.sum("critical").alias("critical"), F.sum("high").alias("high"))


@query(
    "cached_decision_stream", "STR7",
    f"""WITH c AS (SELECT user_id, min({US}) AS decided_us FROM events WHERE event_type = 'signup' GROUP BY 1), r AS (SELECT event_id, user_id, {US} AS us, CASE user_id % 4 WHEN 0 THEN 1800 WHEN 1 THEN 900 WHEN 2 THEN 86400 ELSE 3600 END AS ttl FROM events WHERE event_type = 'view')
SELECT event_id, user_id, us - decided_us AS age_us FROM r JOIN c USING (user_id) WHERE us >= decided_us AND us - decided_us <= CAST(ttl AS BIGINT) * 100 * 1000000""",
)
def cached_decision_stream(spark, d):
    signups = table(spark, d, "events").filter("event_type = 'signup'").withColumn("event_time", utc_instant(F.col("ts")))
    cache = signups.groupBy("user_id").agg(F.unix_micros(F.min("event_time")).alias("decided_us"))
    u = F.col("user_id") % 4
    # Seconds a decision is kept, by what triggered it; a hundredfold here, as events are sparse.
    ttl = F.when(u == 0, 1800).when(u == 1, 900).when(u == 2, 86400).otherwise(3600) * 100
    views = event_stream(spark, d).filter("event_type = 'view'")
    hits = windows.cache_hits(views, cache, ttl)
    return run_to_table(hits.select("event_id", "user_id", (F.unix_micros("event_time") - F.col("decided_us")).alias("age_us")), "cache")
