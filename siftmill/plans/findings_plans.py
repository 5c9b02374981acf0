"""Queries over findings and scan history."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions import scores
from siftmill.operators import incremental, metrics, ordered, pairs, scan
from siftmill.plans import concept_sql as C
from siftmill.plans import sqltext as q
from siftmill.plans.registry import query
from siftmill.plans.scan_plans import CODE_HITS_CTE, CODE_RULES, HITS_CTE, PART_RULES_CTE, PROSE_RULES, code_hits, part_rules, presence_sql
from siftmill.sources import concepts, corpus, rules as R
from siftmill.sources.sinks import top_per_key
from siftmill.sources.tables import table

NOW = "2001-11-05"


def _now():
    return F.lit(f"{NOW} 00:00:00").cast("timestamp_ntz")


@query(
    "recent_violations", "JOI1",
    f"""WITH {C.V} SELECT rule_id, file, line, scan_id, strftime(v.ts, '%Y-%m-%d') AS detected, o_custkey AS project FROM v JOIN orders ON scan_id = o_orderkey
WHERE v.ts >= TIMESTAMP '{NOW}' - INTERVAL 120 DAY AND contains(CAST(o_custkey AS VARCHAR), '7')""",
)
def recent_violations(spark, d):
    recent = concepts.violations(spark, d).filter(F.col("ts") >= _now() - F.expr("INTERVAL 120 DAYS"))
    heads = concepts.scan_heads(spark, d).filter(F.col("project").cast("string").contains("7")).select("scan_id", "project")
    return recent.join(heads, "scan_id").select("rule_id", "file", "line", "scan_id", F.date_format("ts", "yyyy-MM-dd").alias("detected"), "project")


@query(
    "project_rule_counts", "JOI2",
    f"""WITH {C.V} SELECT o_custkey % 100 AS project, rule_id, count(*) AS hits FROM v JOIN orders ON scan_id = o_orderkey
WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY GROUP BY ALL""",
)
def project_rule_counts(spark, d):
    recent = concepts.violations(spark, d).filter(F.col("ts") >= _now() - F.expr("INTERVAL 365 DAYS"))
    heads = concepts.scan_heads(spark, d).select("scan_id", (F.col("project") % 100).alias("project"))
    return recent.join(heads, "scan_id").groupBy("project", "rule_id").agg(F.count("*").alias("hits"))


def _relations(spark, d, steps=3):
    p = table(spark, d, "part").select("p_partkey")
    return p.select(F.col("p_partkey").alias("rule_a"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")).select(
        "rule_a", (F.col("rule_a") + F.col("k")).alias("rule_b")
    )


RELATIONS = "rel AS (SELECT p_partkey AS rule_a, p_partkey + k AS rule_b FROM part, (SELECT unnest([1, 2, 3]) AS k))"
OCC = "occ AS (SELECT DISTINCT l_partkey AS rule_id, l_orderkey AS loc FROM lineitem), n AS (SELECT rule_id, count(*) AS n FROM occ GROUP BY rule_id)"


def _occurrences(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("rule_id"), F.col("l_orderkey").alias("loc"))


@query(
    "rule_pair_correlation", "JOI3",
    f"""WITH {RELATIONS}, {OCC}, c AS (SELECT rule_a, rule_b, count(*) AS c FROM rel JOIN occ a ON a.rule_id = rule_a JOIN occ b ON b.rule_id = rule_b AND a.loc = b.loc GROUP BY ALL),
t AS (SELECT rule_a, rule_b, coalesce(c, 0) AS co_occurrences, coalesce(na.n, 0) AS total_a, coalesce(nb.n, 0) AS total_b
 FROM rel LEFT JOIN c USING (rule_a, rule_b) LEFT JOIN n na ON na.rule_id = rule_a LEFT JOIN n nb ON nb.rule_id = rule_b)
SELECT *, CASE WHEN least(total_a, total_b) > 0 THEN co_occurrences::DOUBLE / least(total_a, total_b) ELSE 0 END AS correlation,
 CASE WHEN total_a + total_b > 0 THEN co_occurrences::DOUBLE / (total_a + total_b - co_occurrences) ELSE 0 END AS jaccard FROM t""",
)
def rule_pair_correlation(spark, d):
    return pairs.cooccurrence_of(_occurrences(spark, d), _relations(spark, d))


@query(
    "correlated_rules", "JOI4",
    f"""WITH {OCC}, c AS (SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS co_occurrences FROM occ a JOIN occ b ON a.loc = b.loc AND a.rule_id < b.rule_id GROUP BY ALL HAVING count(*) >= 2)
SELECT rule_a, rule_b, co_occurrences, na.n AS total_a, nb.n AS total_b, co_occurrences::DOUBLE / least(na.n, nb.n) AS correlation,
 co_occurrences::DOUBLE / (na.n + nb.n - co_occurrences) AS jaccard FROM c JOIN n na ON na.rule_id = rule_a JOIN n nb ON nb.rule_id = rule_b
WHERE co_occurrences::DOUBLE / least(na.n, nb.n) >= 0.09""",
)
def correlated_rules(spark, d):
    return pairs.correlated_rules(_occurrences(spark, d), min_correlation=0.09, min_support=2)


DEDUP_SQL = f"""WITH {C.V}, {RELATIONS}, sym AS (SELECT rule_a, rule_b FROM rel UNION SELECT rule_b, rule_a FROM rel),
f AS (SELECT scan_id, min({{'line': line, 'file': file, 'rule_id': rule_id}}) AS first FROM v GROUP BY scan_id)
SELECT v.scan_id, rule_id, line, file, EXISTS (SELECT 1 FROM sym WHERE rule_a = first.rule_id AND rule_b = v.rule_id) AS removed
FROM v JOIN f ON v.scan_id = f.scan_id"""


@query("related_duplicates", "JOI5", DEDUP_SQL)
def related_duplicates(spark, d):
    hits = concepts.violations(spark, d).select("scan_id", "line", "file", "rule_id")
    return pairs.mark_related_duplicates(hits, _relations(spark, d), ["scan_id"], ["line", "file"]).select("scan_id", "rule_id", "line", "file", "removed")


@query("related_rules", "JOI6", f"WITH {RELATIONS} SELECT rule_a AS rule_id, rule_b AS related FROM (SELECT rule_a, rule_b FROM rel UNION SELECT rule_b, rule_a FROM rel)")
def related_rules(spark, d):
    return pairs.symmetric(_relations(spark, d)).select(F.col("rule_a").alias("rule_id"), F.col("rule_b").alias("related"))


@query(
    "edit_conflicts", "JOI10",
    """WITH e AS (SELECT row_number() OVER () AS id, l_partkey AS file, l_suppkey AS user_id, CAST(l_quantity AS INT) AS a, CAST(l_quantity AS INT) + l_linenumber AS b FROM lineitem),
p AS (SELECT x.file, count(*) FILTER (WHERE NOT (x.b < y.a OR y.b < x.a)) AS same_line, count(*) FILTER (WHERE x.b < y.a OR y.b < x.a) AS same_file
 FROM e x JOIN e y ON x.file = y.file AND x.id < y.id AND x.user_id <> y.user_id GROUP BY x.file)
SELECT file, edits, coalesce(same_line, 0) AS same_line, coalesce(same_file, 0) AS same_file FROM (SELECT file, count(*) AS edits FROM e GROUP BY file) LEFT JOIN p USING (file)""",
)
def edit_conflicts(spark, d):
    start = F.col("l_quantity").cast("int")
    edits = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("user_id"), start.alias("line_start"), (start + F.col("l_linenumber")).alias("line_end")
    )
    return pairs.edit_conflicts(edits)


TASKS = f"{C.V}, tasks AS (SELECT DISTINCT file, category, severity, line, scan_id || '-' || line || '-' || rule_id || '-' || severity AS task_id FROM v)"


def _tasks(spark, d):
    v = concepts.violations(spark, d)
    return v.select("file", "category", "severity", "line", F.concat_ws("-", "scan_id", "line", "rule_id", "severity").alias("task_id")).distinct()


@query(
    "security_first_edges", "JOI16",
    f"""WITH {TASKS}, b AS (SELECT file FROM tasks GROUP BY file HAVING bool_or(category = 'php-security') AND bool_or(category <> 'php-security'))
SELECT file, CASE WHEN category = 'php-security' THEN task_id ELSE 'gate-' || file END AS src,
 CASE WHEN category = 'php-security' THEN 'gate-' || file ELSE task_id END AS dst FROM tasks WHERE file IN (SELECT file FROM b)""",
)
def security_first_edges(spark, d):
    return pairs.security_first_edges(_tasks(spark, d), F.col("category").isin("php-security", "api-security", "auth-security"))


@query(
    "severity_chain", "JOI17",
    f"""WITH {TASKS} SELECT file, task_id, lag(task_id) OVER (PARTITION BY file ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'SUGGEST' THEN 2 ELSE 9 END, line, task_id) AS previous FROM tasks""",
)
def severity_chain(spark, d):
    t = _tasks(spark, d).withColumn("rank", scores.severity_rank(F.col("severity")))
    bucket = F.struct("rank", "line", F.substring("task_id", 1, 2))
    return ordered.chain(t, ["file"], bucket, ["rank", "line", "task_id"], "task_id").select("file", "task_id", "previous")


@query(
    "project_quality", "JOI20",
    f"""WITH {C.SCANS}, l AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) AS rn FROM scans)
SELECT c_custkey AS project, c_mktsegment AS segment, greatest(0.0, 100 - (violations_critical * 10 + violations_high * 2 + violations_suggest * 0.5))::DOUBLE AS quality
FROM l JOIN customer ON c_custkey = project WHERE rn = 1""",
)
def project_quality(spark, d):
    latest = concepts.scans(spark, d).groupBy("project").agg(
        F.max_by(F.struct("violations_critical", "violations_high", "violations_suggest"), F.struct("ts", "scan_id")).alias("l")
    )
    lost = F.col("l.violations_critical") * 10 + F.col("l.violations_high") * 2 + F.col("l.violations_suggest") * F.lit(0.5).cast("double")
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("segment"))
    return latest.join(cust, "project").select("project", "segment", F.greatest(F.lit(0.0), 100 - lost).alias("quality"))


# --- aggregates ----------------------------------------------------------------------------


@query(
    "severity_counts", "AGG1",
    f"""WITH {C.V} SELECT scan_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
 count(*) FILTER (WHERE severity = 'SUGGEST') AS suggest, count(*) AS total FROM v GROUP BY scan_id""",
)
def severity_counts(spark, d):
    return metrics.severity_counts(concepts.violations(spark, d), "scan_id")


@query(
    "rule_summary", "AGG3 AGG2",
    f"""WITH {C.V} SELECT rule_id, severity, count(*) AS "count", count(DISTINCT file) AS total_files,
 array_to_string(list_slice(list_sort(list_distinct(list(file))), 1, 5), ',') AS sample_files FROM v GROUP BY ALL""",
)
def rule_summary(spark, d):
    out = metrics.rule_summary(concepts.violations(spark, d))
    return out.withColumn("sample_files", F.array_join(F.col("sample_files").cast("array<string>"), ","))


@query("top_files", "AGG3", f"WITH {C.V} SELECT file, count(*) AS violations FROM v GROUP BY file ORDER BY violations DESC, file LIMIT 10")
def top_files(spark, d):
    return metrics.top_files(concepts.violations(spark, d))


@query(
    "rule_base_stats", "AGG4",
    f"""WITH {PART_RULES_CTE} SELECT 'severity' AS dimension, severity AS value, count(*) AS rules FROM rules GROUP BY severity
UNION ALL SELECT 'category', category, count(*) FROM rules GROUP BY category UNION ALL SELECT 'type', type, count(*) FROM rules GROUP BY type""",
)
def rule_base_stats(spark, d):
    return metrics.rule_base_stats(R.with_defaults(part_rules(spark, d)))


@query(
    "violation_trend", "AGG5",
    f"""WITH {C.SCANS} SELECT project, strftime(ts, '%Y-%m-%d') AS date, CAST(sum(violations_critical) AS BIGINT) AS critical, CAST(sum(violations_high) AS BIGINT) AS high,
 CAST(sum(violations_suggest) AS BIGINT) AS suggest, CAST(sum(violations_total) AS BIGINT) AS total, CAST(sum(violations_fixed) AS BIGINT) AS fixed, count(*) AS scans
FROM scans WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 730 DAY GROUP BY ALL""",
)
def violation_trend(spark, d):
    return metrics.violation_trend(concepts.scans(spark, d), _now() - F.expr("INTERVAL 730 DAYS"))


@query(
    "project_summary", "AGG6",
    f"""WITH {C.SCANS}, vp AS (SELECT v.*, o_custkey AS project FROM v JOIN orders ON scan_id = o_orderkey),
l AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) AS rn, count(*) OVER (PARTITION BY project) AS total_scans FROM scans),
f AS (SELECT project, count(*) FILTER (WHERE status = 'F') AS fx, count(*) FILTER (WHERE severity = 'SUGGEST') AS dis FROM vp GROUP BY project)
SELECT l.project, total_scans, coalesce(fx, 0) AS total_fixes, coalesce(dis, 0) AS total_dismissed, strftime(ts, '%Y-%m-%d') AS last_date,
 violations_critical AS last_critical, violations_high AS last_high, violations_total AS last_total FROM l LEFT JOIN f ON f.project = l.project WHERE rn = 1""",
)
def project_summary(spark, d):
    v = concepts.violations(spark, d).join(concepts.scan_heads(spark, d).select("scan_id", "project"), "scan_id")
    fixes = v.filter("status = 'F'").select("project")
    dismissed = v.filter("severity = 'SUGGEST'").select("project", F.lit(True).alias("active"))
    return metrics.project_summary(concepts.scans(spark, d), fixes, dismissed)


IMPACTS = """imp AS (SELECT l_suppkey AS file, CAST(greatest(l_linenumber - 4, 0) AS BIGINT) AS regressions,
 CASE WHEN l_quantity < 13 THEN 'LOW' WHEN l_quantity < 26 THEN 'MEDIUM' WHEN l_quantity < 39 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM lineitem)"""


def _impacts(spark, d):
    qn = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("file"), F.greatest(F.col("l_linenumber") - 4, F.lit(0)).cast("long").alias("regressions"),
        F.when(qn < 13, "LOW").when(qn < 26, "MEDIUM").when(qn < 39, "HIGH").otherwise("CRITICAL").alias("risk_level"),
    )


@query(
    "high_impact_files", "AGG7",
    f"""WITH {IMPACTS} SELECT file, count(*) AS fix_count, CAST(sum(regressions) AS BIGINT) AS total_regressions, sum(regressions)::DOUBLE / count(*) AS avg_regressions,
 ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], risk_level))] AS max_risk
FROM imp WHERE regressions > 0 GROUP BY file ORDER BY total_regressions DESC, file LIMIT 10""",
)
def high_impact_files(spark, d):
    return metrics.high_impact_files(_impacts(spark, d))


@query(
    "impact_summary", "AGG8",
    f"""WITH {IMPACTS} SELECT count(*) AS total_impacts, CAST(sum(regressions) AS BIGINT) AS total_regressions, count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS high_risk_count,
 sum(regressions)::DOUBLE / count(*) * 100 AS regression_rate FROM imp""",
)
def impact_summary(spark, d):
    return metrics.impact_summary(_impacts(spark, d))


@query(
    "cross_project_report", "AGG54 SIM15",
    f"""WITH {CODE_HITS_CTE}, h AS (SELECT regexp_extract(path, '(?:themes|plugins)/([^/]+)', 1) AS project, category,
 CASE WHEN path LIKE '%.php' THEN 'wp' WHEN path LIKE '%.js' THEN 'nextjs' END AS platform FROM hits)
SELECT 'project' AS dimension, project AS value, count(*) AS violations FROM h GROUP BY project
UNION ALL SELECT 'platform', platform, count(*) FROM h WHERE platform IS NOT NULL GROUP BY platform UNION ALL SELECT 'category', category, count(*) FROM h GROUP BY category""",
)
def cross_project_report(spark, d):
    from siftmill.operators.mining import platform_of_path, project_of_path

    hits = code_hits(spark, d).select(project_of_path(F.col("path")).alias("project"), platform_of_path(F.col("path")).alias("platform"), "category")
    return metrics.cross_project_report(hits)


def _risk_sql() -> str:
    cases = " ".join(f"WHEN '{s}|{c}' THEN {v}" for (s, c), v in scores.RISK_MATRIX.items())
    eff = " ".join(f"WHEN '{c}' THEN {v}" for c, v in scores.EFFORT_FACTOR.items())
    return f"""WITH {C.V}, a AS (SELECT rule_id, CASE WHEN count(*) >= 32 THEN sum(quantity)::DOUBLE / count(*) END AS avg_min FROM v GROUP BY rule_id),
r AS (SELECT severity, category, v.rule_id, 'R' || v.rule_id || CASE v.rule_id % 11 WHEN 0 THEN '-auth' WHEN 1 THEN '-migration' ELSE '' END AS name, avg_min FROM v JOIN a USING (rule_id))
SELECT severity, category, risk, effort, risk_level, probability, count(*) AS violations FROM (SELECT severity, category,
 (CASE WHEN contains(name, 'migration') THEN 0.9 WHEN contains(name, 'auth') THEN 0.95 ELSE
  CASE severity || '|' || category {cases} ELSE CASE severity WHEN 'CRITICAL' THEN 0.75 WHEN 'HIGH' THEN 0.5 WHEN 'SUGGEST' THEN 0.3 ELSE 0.5 END END END)::DOUBLE AS risk,
 CAST(floor(coalesce(avg_min, (CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 8 ELSE 5 END) * (CASE category {eff} ELSE 1.0 END)::DOUBLE)) AS INT) AS effort,
 CASE WHEN severity = 'CRITICAL' THEN 'HIGH' WHEN category IN ('php-security', 'api-security', 'auth-security', 'performance') THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 (CASE WHEN severity = 'CRITICAL' THEN 0.7 WHEN category IN ('php-security', 'api-security', 'auth-security', 'performance') THEN 0.5 ELSE 0.3 END)::DOUBLE AS probability FROM r) GROUP BY ALL"""


@query("risk_and_effort", "AGG56 AGG57 AGG58", _risk_sql())
def risk_and_effort(spark, d):
    v = concepts.violations(spark, d)
    avg = v.groupBy("rule_id").agg(F.when(F.count("*") >= 32, F.sum("quantity") / F.count("*")).alias("avg_min"))
    rid = F.col("rule_id")
    name = F.concat(F.lit("R"), rid, F.when(rid % 11 == 0, "-auth").when(rid % 11 == 1, "-migration").otherwise(""))
    risk = scores.fix_regression_risk(F.col("severity"), F.col("category"))
    scored = v.join(avg, "rule_id").select(
        "severity", "category", scores.risk_score(F.col("severity"), F.col("category"), name).alias("risk"),
        scores.effort_minutes(F.col("severity"), F.col("category"), F.col("avg_min")).alias("effort"),
        risk["level"].alias("risk_level"), risk["probability"].alias("probability"),
    )
    return scored.groupBy(*scored.columns).agg(F.count("*").alias("violations"))


# --- windows and ranking -------------------------------------------------------------------


@query(
    "capped_violations", "WIN1",
    f"""WITH {C.V}, n AS (SELECT rule_id, file, line, scan_id, quantity, row_number() OVER (PARTITION BY rule_id ORDER BY file, line, scan_id, quantity) AS rn, count(*) OVER (PARTITION BY rule_id) AS c FROM v)
SELECT rule_id, file, line, scan_id, rn, greatest(c - 3, 0) AS overflow FROM n WHERE rn <= 3""",
)
def capped_violations(spark, d):
    v = concepts.violations(spark, d).select("rule_id", "file", "line", "scan_id", "quantity")
    totals = v.groupBy("rule_id").agg(F.greatest(F.count("*") - 3, F.lit(0).cast("long")).alias("overflow"))
    kept = top_per_key(v, ["rule_id"], ["file", "line", "scan_id", "quantity"], 3)
    return kept.join(totals, "rule_id").select("rule_id", "file", "line", "scan_id", "rn", "overflow")


@query(
    "regression_check", "WIN2",
    f"""WITH {C.SCANS}, l AS (SELECT project, violations_critical AS c, violations_high AS h, lag(violations_critical) OVER w AS pc, lag(violations_high) OVER w AS ph,
 row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) AS rn FROM scans WINDOW w AS (PARTITION BY project ORDER BY ts, scan_id))
SELECT project, 'CRITICAL' AS severity, pc AS previous, c AS current, c - pc AS delta FROM l WHERE rn = 1 AND c > pc
UNION ALL SELECT project, 'HIGH', ph, h, h - ph FROM l WHERE rn = 1 AND h > ph""",
)
def regression_check(spark, d):
    return ordered.regressions(concepts.scans(spark, d))


@query("scan_history_latest", "TOP1", f"WITH {C.SCANS} SELECT scan_id, project, strftime(ts, '%Y-%m-%d') AS date, violations_total FROM scans ORDER BY ts DESC, scan_id LIMIT 20")
def scan_history_latest(spark, d):
    # The twenty heads are found first; only their violations are counted.
    heads = concepts.scan_heads(spark, d).orderBy(F.desc("ts"), "scan_id").limit(20)
    counts = concepts.violations(spark, d).join(F.broadcast(heads.select("scan_id")), "scan_id", "left_semi").groupBy("scan_id").agg(F.count("*").alias("n"))
    return heads.join(counts, "scan_id", "left").select(
        "scan_id", "project", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.coalesce("n", F.lit(0).cast("long")).alias("violations_total")
    )


@query(
    "fix_history", "TOP2",
    f"WITH {C.FIXES} SELECT rule_id, file, fix_type, verified, strftime(ts, '%Y-%m-%d') AS date FROM fixes WHERE rule_id = 7 ORDER BY ts DESC, rule_id, file LIMIT 20",
)
def fix_history(spark, d):
    fixes = concepts.fixes(spark, d).filter(F.col("rule_id") == 7)
    return fixes.orderBy(F.desc("ts"), "rule_id", "file").limit(20).select("rule_id", "file", "fix_type", "verified", F.date_format("ts", "yyyy-MM-dd").alias("date"))


@query(
    "deployment_history", "TOP3",
    "SELECT o_orderkey AS scan_id, o_custkey AS project, o_orderpriority AS target, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderpriority = '1-URGENT' AND contains(CAST(o_custkey AS VARCHAR), '1') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
)
def deployment_history(spark, d):
    heads = concepts.scan_heads(spark, d).filter((F.col("priority") == "1-URGENT") & F.col("project").cast("string").contains("1"))
    return heads.orderBy(F.desc("ts"), "scan_id").limit(50).select(
        "scan_id", "project", F.col("priority").alias("target"), F.date_format("ts", "yyyy-MM-dd").alias("date")
    )


@query(
    "report_order", "TOP6",
    f"""WITH {CODE_HITS_CTE}, r AS (SELECT rule_id, severity, path, line_no, substr(match_text, 1, 100) AS shown_text, row_number() OVER (PARTITION BY rule_id ORDER BY path, line_no) AS rn FROM hits),
g AS (SELECT rule_id, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'SUGGEST' THEN 2 ELSE 9 END, rule_id) AS place, total FROM (SELECT rule_id, severity, count(*) AS total FROM hits GROUP BY ALL))
SELECT place, rule_id, severity, total, rn, path, line_no, shown_text FROM r JOIN g USING (rule_id) WHERE rn <= 5""",
)
def report_order(spark, d):
    from pyspark.sql import Window as W

    hits = code_hits(spark, d)
    totals = hits.groupBy("rule_id", "severity").agg(F.count("*").alias("total"))
    # One row per rule from here on.
    placed = totals.withColumn("place", F.row_number().over(W.orderBy(scores.severity_rank(F.col("severity")), "rule_id")))
    shown = top_per_key(hits, ["rule_id"], ["path", "line_no"], 5)
    return shown.join(placed.select("rule_id", "place", "total"), "rule_id").select(
        "place", "rule_id", "severity", "total", "rn", "path", "line_no", F.substring("match_text", 1, 100).alias("shown_text")
    )


# --- sets and incremental ------------------------------------------------------------------

ROOT_RULES = [r for r in CODE_RULES if r.rule_id == "credential"]
SUB_RULES = [r for r in CODE_RULES if r.rule_id in ("raw-input", "debug-call")]


@query(
    "merged_reports", "SET1 FIL10",
    f"""WITH {q.CODE_LINES_CTE}, h AS ({presence_sql('code_lines', ROOT_RULES + SUB_RULES)})
SELECT rule_id, project AS label, CASE WHEN rule_id = 'credential' THEN path ELSE regexp_replace(path, '^themes/', '') END AS path, line_no FROM h""",
)
def merged_reports(spark, d):
    files = corpus.with_lines(corpus.code_files(spark, d))
    root = scan.scan_presence(files, ROOT_RULES)
    relative = files.withColumn("path", F.regexp_replace("path", "^themes/[^/]+/", ""))
    sub = scan.scan_presence(relative, SUB_RULES)
    return incremental.merge_labelled(root, sub).select("rule_id", F.col("project").alias("label"), "path", "line_no")


@query("incremental_scan", "SET2", f"WITH {HITS_CTE} SELECT rule_id, project, path, line_no, match_text FROM hits")
def incremental_scan(spark, d):
    from siftmill.plans.scan_plans import _snapshot

    files = corpus.spread(corpus.document_files(spark, d)).select("project", "path", "content")
    old = _snapshot(files)
    version = F.lit("v1")
    # Half a rule set ago some files were scanned with other rules; those are not reused.
    cache = incremental.content_hashes(old).withColumn("rule_version", F.when(F.col("project") == "src5", F.lit("v0")).otherwise(version))
    old_hits = scan.scan_presence(old, PROSE_RULES)
    out = incremental.incremental_scan(files, cache, old_hits, version, lambda f: scan.scan_presence(f, PROSE_RULES))
    return out.select("rule_id", "project", "path", "line_no", "match_text")


@query(
    "rule_set_version", "SET3",
    """WITH r AS (SELECT sha256(concat_ws(chr(31), p_partkey, p_name, p_brand, p_type)) AS h FROM part),
b AS (SELECT CAST('0x' || substr(h, 1, 2) AS INT) % 64 AS b, sha256(string_agg(h, '' ORDER BY h)) AS bh FROM r GROUP BY 1)
SELECT substr(sha256(string_agg(bh, '' ORDER BY b)), 1, 16) AS rule_version FROM b""",
)
def rule_set_version(spark, d):
    return incremental.rule_set_version(table(spark, d, "part"), ["p_partkey", "p_name", "p_brand", "p_type"])


CACHE = "cache AS (SELECT 'doc-' || doc_id AS path, sha256(text) AS sha256, lang AS rule_version, DATE '2024-01-01' + CAST(doc_id % 90 AS INT) AS scanned_at FROM documents)"


@query(
    "cache_stats", "SET4",
    f"""WITH {CACHE} SELECT 'before' AS stage, count(*) AS total_entries, count(DISTINCT rule_version) AS versions, strftime(max(scanned_at), '%Y-%m-%d') AS last_scan FROM cache
UNION ALL SELECT 'after', count(*), count(DISTINCT rule_version), strftime(max(scanned_at), '%Y-%m-%d') FROM cache WHERE scanned_at >= DATE '2024-03-01'""",
)
def cache_stats(spark, d):
    docs = table(spark, d, "documents")
    cache = docs.select(
        F.concat(F.lit("doc-"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("rule_version"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("scanned_at"),
    )
    kept = incremental.evict_older(cache, F.lit("2024-03-01").cast("date"))
    before, after = (incremental.cache_stats(c).withColumn("stage", F.lit(s)) for c, s in ((cache, "before"), (kept, "after")))
    return before.unionByName(after).withColumn("last_scan", F.date_format("last_scan", "yyyy-MM-dd"))
