"""SQL twins of ``sources.concepts`` (DuckDB dialect), as WITH-list members."""

from __future__ import annotations

from siftmill.plans.sqltext import sql_list
from siftmill.sources.concepts import CATEGORIES, TASK_TYPES

V = f"""v AS (SELECT l_orderkey AS scan_id, l_partkey AS rule_id, l_suppkey AS file, l_linenumber AS line,
  CASE l_returnflag WHEN 'A' THEN 'CRITICAL' WHEN 'N' THEN 'HIGH' ELSE 'SUGGEST' END AS severity,
  {sql_list(CATEGORIES)}[CAST(l_partkey % {len(CATEGORIES)} AS INT) + 1] AS category,
  l_linestatus AS status, CAST(l_quantity AS BIGINT) AS quantity, l_shipdate AS ts FROM lineitem)"""

SCANS = (
    V
    + """, vc AS (SELECT scan_id, count(*) AS violations_total, count(*) FILTER (WHERE severity = 'CRITICAL') AS violations_critical,
  count(*) FILTER (WHERE severity = 'HIGH') AS violations_high, count(*) FILTER (WHERE severity = 'SUGGEST') AS violations_suggest,
  count(*) FILTER (WHERE status = 'F') AS violations_fixed FROM v GROUP BY scan_id),
scans AS (SELECT o_orderkey AS scan_id, o_custkey AS project, o_orderdate AS ts, o_orderstatus AS status, o_orderpriority AS priority,
  coalesce(violations_total, 0) AS violations_total, coalesce(violations_critical, 0) AS violations_critical,
  coalesce(violations_high, 0) AS violations_high, coalesce(violations_suggest, 0) AS violations_suggest,
  coalesce(violations_fixed, 0) AS violations_fixed FROM orders LEFT JOIN vc ON o_orderkey = scan_id)"""
)

STATE = """fb AS (SELECT l_partkey AS rule_id, CASE l_returnflag WHEN 'A' THEN 'tp' WHEN 'R' THEN 'fp' END AS outcome,
  l_linestatus = 'F' AS fixed, l_shipdate AS ts FROM lineitem),
st0 AS (SELECT rule_id, count(*) AS total_hits, count(*) FILTER (WHERE outcome = 'tp') AS true_positives,
  count(*) FILTER (WHERE outcome = 'fp') AS false_positives, count(*) FILTER (WHERE fixed) AS fix_success,
  count(*) FILTER (WHERE NOT fixed) AS fix_failure, max(ts) AS last_hit FROM fb GROUP BY rule_id),
st1 AS (SELECT *, CASE rule_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'SUGGEST' END AS severity,
  CASE WHEN fix_success + fix_failure > 0 THEN (1.0::DOUBLE - false_positives::DOUBLE / total_hits) * 0.7::DOUBLE + (fix_success::DOUBLE / (fix_success + fix_failure)) * 0.3::DOUBLE
       ELSE 1.0::DOUBLE - false_positives::DOUBLE / total_hits END AS confidence FROM st0),
state AS (SELECT *, CASE WHEN confidence < 0.3 THEN 'SUGGEST' WHEN confidence < 0.5 AND severity = 'HIGH' THEN 'SUGGEST' ELSE severity END AS effective_severity FROM st1)"""

FIXES = """fixes AS (SELECT l_partkey AS rule_id, l_suppkey AS file, ['replace', 'insert', 'wrap'][l_linenumber % 3 + 1] AS fix_type,
  l_linestatus = 'F' AS verified, l_returnflag = 'R' AS rolled_back, l_shipdate AS ts FROM lineitem)"""

GENERATIONS = """gens AS (SELECT l_partkey AS project, l_suppkey AS template, l_orderkey * 8 + l_linenumber AS gen_id,
  100 - CAST(round(l_discount * 100) AS BIGINT) AS quality_pct, CAST(l_linenumber AS BIGINT) AS fix_count,
  CAST(l_quantity AS BIGINT) AS violations_at_gen, l_shipdate AS ts FROM lineitem)"""

DETECTIONS = """det AS (SELECT ['header', 'hero', 'card', 'button', 'badge', 'grid', 'image'][CAST(l_suppkey % 7 AS INT) + 1] AS component_type,
  50 + 5 * CAST(round(l_discount * 100) AS BIGINT) AS confidence_pct, (50 + 5 * CAST(round(l_discount * 100) AS BIGINT))::DOUBLE / 100 AS confidence,
  l_linestatus = 'F' AS auto_applied,
  CASE WHEN l_returnflag = 'A' THEN true WHEN l_returnflag = 'R' AND l_quantity > 30 THEN false END AS accepted,
  '<div>' || CAST(l_quantity AS INT) || '</div>' AS snippet, l_orderkey AS gen_id, l_linenumber AS line, l_shipdate AS ts FROM lineitem)"""

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
LOCAL = "event_type IN ('view', 'click')"

USAGE = f"""u AS (SELECT event_id, ts, user_id, event_type AS operation, {K} * 10 AS tokens_local,
  CASE WHEN {LOCAL} THEN 0 ELSE {K} * 5 END AS tokens_remote,
  CASE WHEN {LOCAL} THEN 0::DECIMAL(18,4) ELSE value::DECIMAL(18,4) END AS cost_actual, (value::DECIMAL(18,4) * 2)::DECIMAL(18,4) AS cost_baseline,
  {K} * 7 AS latency_ms, {K} * 40 + 2500 AS tokens_baseline, {K} * 90 AS latency_baseline_ms, {K} AS k FROM events)"""

WEEK = "CAST(floor(epoch_us(ts) / 1000000 / 604800) AS BIGINT)"

SESSIONS = f"""s AS (SELECT event_id, user_id || '-' || {WEEK} AS session_id, user_id, {WEEK} AS week, ts,
  CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Read' WHEN 'purchase' THEN 'Write' WHEN 'signup' THEN 'Edit' ELSE 'Bash' END AS tool,
  'f' || ({K} % 6) || '.php' AS file_path, {sql_list(TASK_TYPES)}[CAST(user_id % {len(TASK_TYPES)} AS INT) + 1] AS task_type, {K} AS k FROM events)"""
