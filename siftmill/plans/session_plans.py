"""Queries over session logs: quality, trust, shared files, facts and conventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions import scores
from siftmill.functions.usage import epoch_week
from siftmill.operators import ordered, sessions as S
from siftmill.plans import concept_sql as C
from siftmill.plans.registry import query
from siftmill.sources import concepts
from siftmill.sources.sinks import top_per_key
from siftmill.sources.tables import table

BRIEF = ["f0.php", "f1.php"]
LAST_WEEK = 2821  # the week of 2024-01-25
LEVEL_RANK = {"brief_only": 0, "skeleton": 1, "draft": 2, "ready": 3}

PF = f"""{C.SESSIONS}, pf AS (SELECT session_id, task_type, user_id, week, file_path, count(*) AS calls, count(*) FILTER (WHERE tool = 'Read') AS reads, count(*) FILTER (WHERE tool IN ('Write', 'Edit')) AS writes,
 count(*) FILTER (WHERE tool = 'Edit') AS edits, min(ts) AS first_ts, max(ts) AS last_ts, min(ts) FILTER (WHERE tool IN ('Write', 'Edit')) AS first_write, max(ts) FILTER (WHERE tool = 'Bash') AS last_error, max(k) AS k FROM s GROUP BY ALL)"""
PENALTY = "CASE task_type WHEN 'checkout_page' THEN 0.05 WHEN 'product_page' THEN 0.03 WHEN 'fix_css' THEN 0.0 ELSE 0.02 END"
OQ = f"""{PF}, oq0 AS (SELECT session_id, task_type, week, CAST(sum(CASE WHEN file_path IN ('f0.php', 'f1.php') THEN reads ELSE 0 END) AS BIGINT) AS files_re_read, greatest(max(edits) - 1, 0) AS edits_after_first,
 CAST(sum(calls) AS BIGINT) AS total_calls, CAST(sum(calls) * 50 + sum(reads) * 200 + sum(writes) * 500 AS BIGINT) AS tokens, sum(writes) AS w, epoch_us(max(last_ts)) AS e1, epoch_us(min(first_ts)) AS e0, max(last_ts) AS ended, max(k) AS trust_pct FROM pf GROUP BY ALL),
oq AS (SELECT *, CAST((e1 - e0) // 1000000 AS BIGINT) AS duration_sec, CASE WHEN trust_pct::DOUBLE / 100 - {PENALTY}::DOUBLE >= 0.95 THEN 'ready' WHEN trust_pct::DOUBLE / 100 - {PENALTY}::DOUBLE >= 0.85 THEN 'draft' WHEN trust_pct::DOUBLE / 100 - {PENALTY}::DOUBLE >= 0.6 THEN 'skeleton' ELSE 'brief_only' END AS level FROM oq0 WHERE w > 0),
oql AS (SELECT *, list_position(['brief_only', 'skeleton', 'draft', 'ready'], level) - 1 AS level_rank FROM oq)"""
DASH = "count(*) AS sessions, sum(tokens)::DOUBLE / count(*) AS avg_tokens, sum(files_re_read)::DOUBLE / count(*) AS avg_re_reads, sum(edits_after_first)::DOUBLE / count(*) AS avg_edits, sum(trust_pct)::DOUBLE / count(*) / 100 AS avg_trust, sum(level_rank)::DOUBLE / count(*) AS avg_level"


def _quality(spark, d):
    out = S.output_quality(concepts.session_log(spark, d), BRIEF)
    level = scores.output_level(F.col("trust_pct") / 100, F.col("task_type"))
    return out.withColumn("level", level).withColumn("level_rank", scores.lookup(LEVEL_RANK, F.col("level"), F.lit(0)))


@query("session_quality", "AGG36", f"WITH {PF} SELECT session_id, task_type, count(*) FILTER (WHERE reads > 1) AS re_reads, count(*) FILTER (WHERE writes > 2) AS multi_edits, CAST(sum(calls) AS BIGINT) AS total_calls FROM pf GROUP BY ALL")
def session_quality(spark, d):
    return S.session_quality(concepts.session_log(spark, d))


@query("output_quality", "AGG38 FUN24 FUN6", f"WITH {OQ} SELECT session_id, task_type, week, files_re_read, edits_after_first, total_calls, tokens, duration_sec, trust_pct, level FROM oq")
def output_quality(spark, d):
    return _quality(spark, d).select("session_id", "task_type", "week", "files_re_read", "edits_after_first", "total_calls", "tokens", "duration_sec", "trust_pct", "level")


@query(
    "trust_from_feedback", "AGG37",
    f"""WITH {PF}, sq AS (SELECT session_id, task_type, count(*) FILTER (WHERE reads > 1) AS r, count(*) FILTER (WHERE writes > 2) AS m FROM pf GROUP BY ALL)
SELECT task_type, count(*) AS sessions, greatest(1.0::DOUBLE - least(sum(r)::DOUBLE / count(*) * 0.08::DOUBLE + sum(m)::DOUBLE / count(*) * 0.12::DOUBLE, 0.7::DOUBLE), 0.3::DOUBLE) AS trust FROM sq GROUP BY task_type HAVING count(*) >= 3""",
)
def trust_from_feedback(spark, d):
    return S.trust_baseline(S.session_quality(concepts.session_log(spark, d)))


@query("weekly_dashboard", "AGG32 FUN6", f"WITH {OQ} SELECT week, {DASH} FROM oql GROUP BY week")
def weekly_dashboard(spark, d):
    return S.weekly_dashboard(_quality(spark, d), "week")


@query("task_type_dashboard", "AGG32", f"WITH {OQ} SELECT task_type, {DASH} FROM oql WHERE week >= {LAST_WEEK} - 3 GROUP BY task_type")
def task_type_dashboard(spark, d):
    return S.weekly_dashboard(_quality(spark, d).filter(F.col("week") >= LAST_WEEK - 3), "task_type")


@query("level_shares", "AGG32 FUN24", f"WITH {OQ} SELECT level, count(*) AS sessions, count(*)::DOUBLE / (SELECT count(*) FROM oq) * 100 AS share FROM oq GROUP BY level")
def level_shares(spark, d):
    return S.level_shares(_quality(spark, d))


@query(
    "progress_score", "AGG33",
    f"""WITH {OQ}, w AS (SELECT week, {DASH} FROM oql GROUP BY week), f AS (SELECT * FROM w ORDER BY week LIMIT 1), t AS (SELECT * FROM w ORDER BY week DESC LIMIT 1)
SELECT (SELECT count(*) FROM w) AS weeks, least(greatest((1 - t.avg_tokens / f.avg_tokens) * 100, 0), 30) + least(t.avg_trust * 30, 30) + least(t.avg_level / 3 * 20, 20)
 + CASE WHEN f.avg_re_reads > 0 THEN least(greatest((1 - t.avg_re_reads / f.avg_re_reads) * 20, 0), 20) ELSE 20 END AS score FROM f, t""",
)
def progress_score(spark, d):
    return S.progress_score(S.weekly_dashboard(_quality(spark, d), "week"))


@query(
    "stagnation_alert", "AGG34",
    f"""WITH {OQ}, x AS (SELECT week >= {LAST_WEEK} - 1 AS recent, sum(tokens)::DOUBLE / count(*) AS tk, sum(trust_pct)::DOUBLE / count(*) / 100 AS tr, sum(level_rank)::DOUBLE / count(*) AS lv, count(*) AS n FROM oql WHERE week BETWEEN {LAST_WEEK} - 3 AND {LAST_WEEK} GROUP BY 1),
y AS (SELECT (b.tk - r.tk) / greatest(b.tk, 1.0) AS token_improvement, r.tr - b.tr AS trust_improvement, r.lv - b.lv AS level_improvement, least((r.n + b.n)::DOUBLE / 10, 1.0::DOUBLE) AS confidence FROM x r JOIN x b ON r.recent AND NOT b.recent)
SELECT *, token_improvement < 0.05 AND trust_improvement < 0.02 AND level_improvement < 0.1 AND confidence >= 0.5 AS stagnating FROM y""",
)
def stagnation_alert(spark, d):
    return S.stagnation(_quality(spark, d), LAST_WEEK)


@query(
    "reads_before_write", "JOI11",
    f"""WITH {C.SESSIONS}, w AS (SELECT session_id, file_path AS written, min(ts) AS fw FROM s WHERE tool IN ('Write', 'Edit') GROUP BY ALL)
SELECT w.session_id, written, s.file_path, s.event_id, CAST(row_number() OVER (PARTITION BY w.session_id, written ORDER BY s.ts, s.event_id) AS INT) AS place FROM w JOIN s ON s.session_id = w.session_id AND s.tool = 'Read' AND s.ts < fw""",
)
def reads_before_write(spark, d):
    from pyspark.sql import Window as W

    rows = S.reads_before_write(concepts.session_log(spark, d))
    w = W.partitionBy("session_id", "written").orderBy("ts", "event_id")
    return rows.select("session_id", "written", "file_path", "event_id", F.row_number().over(w).alias("place"))


CP = f"""{PF}, cp AS (SELECT session_id, task_type, user_id, list_sort(list(file_path) FILTER (WHERE reads > 0)) AS fr, list_sort(list(file_path) FILTER (WHERE writes > 0)) AS fw, max(last_ts) AS ended FROM pf GROUP BY ALL)"""


@query("context_patterns", "FUN19", f"WITH {CP} SELECT session_id, coalesce(array_to_string(fr, ','), '') AS files_read, coalesce(array_to_string(fw, ','), '') AS files_written FROM cp")
def context_patterns(spark, d):
    rows = S.context_patterns(concepts.session_log(spark, d))
    return rows.select("session_id", *[F.array_join(F.from_json(c, "array<string>"), ",").alias(c) for c in ("files_read", "files_written")])


@query(
    "common_files", "AGG39 FUN19",
    f"""WITH {CP}, l AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY ended DESC, session_id) AS rn, count(*) OVER (PARTITION BY task_type) AS sessions FROM cp),
r AS (SELECT task_type, sessions, unnest(fr) AS file_path FROM l WHERE rn <= 20), n AS (SELECT task_type, count(*) AS sampled FROM l WHERE rn <= 20 GROUP BY 1)
SELECT task_type, file_path, count(*) AS seen, any_value(sampled) AS sampled, least(any_value(sessions)::DOUBLE / 20, 1.0::DOUBLE) AS confidence FROM r JOIN n USING (task_type) GROUP BY task_type, file_path HAVING count(*) >= greatest(3, floor(any_value(sampled) * 0.6))""",
)
def common_files(spark, d):
    return S.common_files(S.context_patterns(concepts.session_log(spark, d)))


SIG = f"""{PF}, sig AS (SELECT session_id, task_type, count(*) FILTER (WHERE reads > 0 AND file_path NOT IN ('f0.php', 'f1.php')) > 3 AS brief_insufficient, max(edits) > 2 AS multiple_rewrites,
 coalesce(max(last_error) > min(first_write), false) AS errors_after_write, max(last_ts) AS ended FROM pf GROUP BY ALL),
sg AS (SELECT *, CAST(brief_insufficient AS INT) + CAST(multiple_rewrites AS INT) + CAST(errors_after_write AS INT) AS negative, [5, 0, -8, -15][CAST(brief_insufficient AS INT) + CAST(multiple_rewrites AS INT) + CAST(errors_after_write AS INT) + 1] AS delta FROM sig)"""


@query("trust_signals", "AGG40", f"WITH {SIG} SELECT session_id, task_type, brief_insufficient, multiple_rewrites, errors_after_write, negative, delta FROM sg")
def trust_signals(spark, d):
    return S.trust_signals(concepts.session_log(spark, d), BRIEF).drop("ended")


@query(
    "running_trust", "WIN7 STR4",
    f"""WITH {SIG} SELECT task_type, list_reduce(list(CAST(delta AS BIGINT) ORDER BY ended, session_id), lambda a, x: least(95, greatest(10, a + x)), CAST(50 AS BIGINT)) AS value, count(*) AS events FROM sg GROUP BY task_type""",
)
def running_trust(spark, d):
    signals = S.trust_signals(concepts.session_log(spark, d), BRIEF)
    buckets = [F.date_trunc("hour", "ended"), F.date_trunc("day", "ended")]
    # A coarser bucket holds finer ones, so each level folds consecutive runs.
    return ordered.clamped_value(signals, ["task_type"], ["ended", "session_id"], "delta", S.TRUST_START, S.TRUST_MIN, S.TRUST_MAX, buckets)


@query(
    "attempt_levels", "AGG41",
    f"""WITH {OQ}, o AS (SELECT oq.task_type, level, NOT errors_after_write AS ok FROM oq JOIN (SELECT session_id, coalesce(max(last_error) > min(first_write), false) AS errors_after_write FROM pf GROUP BY 1) USING (session_id))
SELECT task_type, level, count(*) AS tries, count(*) FILTER (WHERE ok)::DOUBLE / count(*) AS success_rate,
 count(*) < 3 OR count(*) FILTER (WHERE ok)::DOUBLE / count(*) >= (CASE level WHEN 'skeleton' THEN 0.3 WHEN 'draft' THEN 0.5 WHEN 'ready' THEN 0.7 ELSE 0.5 END)::DOUBLE AS attempt FROM o GROUP BY task_type, level""",
)
def attempt_levels(spark, d):
    signals = S.trust_signals(concepts.session_log(spark, d), BRIEF).select("session_id", "errors_after_write")
    outcomes = _quality(spark, d).join(signals, "session_id").select("task_type", "level", (~F.col("errors_after_write")).alias("success"))
    return S.attempt_levels(outcomes)


WFB = f"{C.SESSIONS}, wf AS (SELECT task_type, CASE user_id % 3 WHEN 0 THEN 'low_data' WHEN 1 THEN 'high_failure' ELSE 'stale_baseline' END AS warning, CASE WHEN k % 10 = 9 THEN NULL ELSE k % 10 > 2 + user_id % 7 END AS useful, ts, event_id FROM s)"
SUPP = f"{WFB}, sp AS (SELECT task_type, warning, count(*) AS n, count(*) FILTER (WHERE NOT useful) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY task_type, warning ORDER BY ts DESC, event_id) AS rn FROM wf WHERE useful IS NOT NULL) WHERE rn <= 10 GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (WHERE NOT useful)::DOUBLE / count(*) >= 0.7)"


def _warning_feedback(spark, d):
    k, u = F.col("k"), F.col("user_id")
    return concepts.session_log(spark, d).select(
        "task_type", F.when(u % 3 == 0, "low_data").when(u % 3 == 1, "high_failure").otherwise("stale_baseline").alias("warning"),
        F.when(k % 10 != 9, k % 10 > 2 + u % 7).alias("useful"), "ts", "event_id",
    )


@query("suppressed_warnings", "AGG43", f"WITH {SUPP} SELECT task_type, warning, n, bad FROM sp")
def suppressed_warnings(spark, d):
    return S.suppressed_warnings(_warning_feedback(spark, d))


@query(
    "task_warnings", "AGG42",
    f"""WITH {SUPP}, {SIG.replace(C.SESSIONS + ', ', '')}, cp AS (SELECT DISTINCT session_id, task_type, user_id % 40 AS theme FROM s),
rq AS (SELECT DISTINCT task_type, user_id % 40 AS theme FROM s UNION SELECT 'new_page', user_id % 40 FROM s), t AS (SELECT task_type, count(*) AS a FROM cp GROUP BY 1), h AS (SELECT task_type, theme, count(*) AS b FROM cp GROUP BY ALL),
rf AS (SELECT task_type, count(*) AS n, count(*) FILTER (WHERE multiple_rewrites OR errors_after_write) AS f FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY ended DESC, session_id) AS rn FROM sg) WHERE rn <= 10 GROUP BY 1),
bl AS (SELECT task_type, max(ts) - INTERVAL (CASE WHEN task_type = 'fix_css' THEN 20 ELSE 1 END) DAY AS lc FROM s GROUP BY 1), j AS (SELECT rq.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b, n, f, lc FROM rq LEFT JOIN t USING (task_type) LEFT JOIN h USING (task_type, theme) LEFT JOIN rf USING (task_type) LEFT JOIN bl USING (task_type)),
w AS (SELECT task_type, theme, 'novel_task' AS warning FROM j WHERE a = 0 UNION ALL SELECT task_type, theme, 'low_data' FROM j WHERE a > 0 AND b < 3 UNION ALL SELECT task_type, theme, 'high_failure' FROM j WHERE n >= 3 AND f::DOUBLE / n > 0.4
 UNION ALL SELECT task_type, theme, 'stale_baseline' FROM j WHERE TIMESTAMP '2024-01-31' > lc + INTERVAL 14 DAY)
SELECT task_type, theme, warning FROM w WHERE (task_type, warning) NOT IN (SELECT task_type, warning FROM sp)""",
)
def task_warnings(spark, d):
    log = concepts.session_log(spark, d)
    theme = (F.col("user_id") % 40).alias("theme")
    patterns = log.select("session_id", "task_type", theme).distinct()
    asked = log.select("task_type", theme).distinct()
    requests = asked.unionByName(asked.select(F.lit("new_page").alias("task_type"), "theme").distinct())
    days = F.when(F.col("task_type") == "fix_css", 20).otherwise(1)
    baselines = log.groupBy("task_type").agg(F.max("ts").alias("t")).select("task_type", (F.col("t") - F.make_dt_interval(days)).alias("last_calibrated"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return S.task_warnings(requests, patterns, S.trust_signals(log, BRIEF), baselines, S.suppressed_warnings(_warning_feedback(spark, d)), now)


TP = f"{C.SESSIONS}, tp AS (SELECT user_id AS pattern_id, task_type, count(*) FILTER (WHERE tool <> 'Bash') AS success, count(*) FILTER (WHERE tool = 'Bash') AS failure FROM s GROUP BY ALL)"


def _theme_patterns(spark, d):
    return concepts.session_log(spark, d).groupBy(F.col("user_id").alias("pattern_id"), "task_type").agg(
        F.count_if(F.col("tool") != "Bash").alias("success"), F.count_if(F.col("tool") == "Bash").alias("failure")
    )


@query(
    "transferable_patterns", "AGG44",
    f"WITH {TP} SELECT task_type, pattern_id, confidence, success FROM (SELECT *, success::DOUBLE / (success + failure) AS confidence, row_number() OVER (PARTITION BY task_type ORDER BY success::DOUBLE / (success + failure) DESC, success DESC, pattern_id) AS rn FROM tp WHERE success >= 2 AND success::DOUBLE / (success + failure) >= 0.7) WHERE rn = 1",
)
def transferable_patterns(spark, d):
    return S.transferable_pattern(_theme_patterns(spark, d))


@query(
    "kept_patterns", "WIN11",
    f"WITH {TP} SELECT task_type, pattern_id FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY success::DOUBLE / greatest(success + failure, 1) DESC, pattern_id) AS rn FROM tp) WHERE rn <= 3",
)
def kept_patterns(spark, d):
    rate = scores.ratio(F.col("success"), F.greatest(F.col("success") + F.col("failure"), F.lit(1).cast("long")))
    rows = _theme_patterns(spark, d).withColumn("rate", rate)
    return ordered.newest_per_key(rows, ["task_type"], [F.desc("rate"), "pattern_id"], 3).select("task_type", "pattern_id")


# --- facts ---------------------------------------------------------------------------------

FACTS = f"{C.SESSIONS}, fc AS (SELECT user_id AS project, 'style-' || (k % 2) AS key, tool AS value, task_type, file_path AS binding, ts, event_id FROM s)"
RUNS = f"""{FACTS}, lr AS (SELECT project, key, last(value ORDER BY ts, event_id) AS lv FROM fc GROUP BY ALL), br AS (SELECT project, key, max({{'ts': ts, 'e': event_id}}) AS b FROM fc JOIN lr USING (project, key) WHERE value <> lv GROUP BY ALL),
runs AS (SELECT project, key, lv AS value, count(*) AS times_seen FROM fc JOIN lr USING (project, key) LEFT JOIN br USING (project, key) WHERE b IS NULL OR {{'ts': ts, 'e': event_id}} > b GROUP BY ALL)"""


def _facts(spark, d):
    return concepts.session_log(spark, d).select(
        F.col("user_id").alias("project"), F.concat(F.lit("style-"), F.col("k") % 2).alias("key"), F.col("tool").alias("value"), "task_type", F.col("file_path").alias("binding"), "ts", "event_id"
    )


def _runs(spark, d):
    return ordered.last_run(_facts(spark, d), ["project", "key"], "value", ["ts", "event_id"])


@query("style_facts", "WIN8", f"WITH {RUNS} SELECT project, key, value, times_seen FROM runs")
def style_facts(spark, d):
    return _runs(spark, d).select("project", "key", "value", "times_seen")


USES = f"{FACTS}, us AS (SELECT task_type, binding, project, count(*) AS times_seen, min(ts) AS f, max(ts) AS l FROM fc GROUP BY ALL)"


def _uses(spark, d):
    return _facts(spark, d).groupBy("task_type", "binding", "project").agg(F.count("*").alias("times_seen"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("usage_facts", "WIN9", f"WITH {USES} SELECT task_type, binding, project, times_seen, strftime(f, '%Y-%m-%d') AS first_seen, strftime(l, '%Y-%m-%d') AS last_seen FROM us")
def usage_facts(spark, d):
    return _uses(spark, d).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")})


@query("mature_facts", "WIN13", f"WITH {USES} SELECT task_type, binding, project, times_seen, times_seen >= 10 AND project <> 0 AS blessed FROM us")
def mature_facts(spark, d):
    named = F.when(F.col("project") == 0, "unknown").otherwise(F.col("project").cast("string"))
    return ordered.blessed(_uses(spark, d).withColumn("id", F.col("project")).withColumn("project", named)).select("task_type", "binding", F.col("id").alias("project"), "times_seen", "blessed")


@query(
    "project_conventions", "TOP9",
    f"WITH {USES} SELECT project, task_type, binding, times_seen, blessed, rn FROM (SELECT *, times_seen >= 10 AS blessed, CAST(row_number() OVER (PARTITION BY project ORDER BY times_seen >= 10 DESC, times_seen DESC, task_type, binding) AS INT) AS rn FROM us) WHERE rn <= 4",
)
def project_conventions(spark, d):
    rows = _uses(spark, d).withColumn("blessed", F.col("times_seen") >= 10)
    return top_per_key(rows, ["project"], [F.desc("blessed"), F.desc("times_seen"), "task_type", "binding"], 4).select("project", "task_type", "binding", "times_seen", "blessed", "rn")


@query("novel_facts", "JOI19", f"WITH {USES}, kn AS (SELECT DISTINCT task_type, binding FROM us WHERE project % 2 = 0 AND times_seen >= 25) SELECT task_type, binding, project FROM us WHERE project % 2 = 1 AND (task_type, binding) NOT IN (SELECT task_type, binding FROM kn)")
def novel_facts(spark, d):
    uses = _uses(spark, d)
    return S.novel_facts(uses.filter("project % 2 = 1"), uses.filter("project % 2 = 0"), min_seen=25).select("task_type", "binding", "project")


COLD = f"{RUNS}, pj AS (SELECT DISTINCT user_id AS project, user_id % 7 AS industry FROM events), kf AS (SELECT * FROM runs WHERE project % 15 <> 0)"


def _projects(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("project"), (F.col("user_id") % 7).alias("industry")).distinct()


@query(
    "cold_start_facts", "JOI18",
    f"""WITH {COLD}, b AS (SELECT industry, key, max({{'n': times_seen, 'v': value}}) AS b FROM kf JOIN pj USING (project) GROUP BY ALL)
SELECT project, industry, key, b.v AS value, 1 AS times_seen FROM pj JOIN b USING (industry) WHERE project NOT IN (SELECT project FROM kf)""",
)
def cold_start_facts(spark, d):
    return S.cold_start(_projects(spark, d), _runs(spark, d).filter("project % 15 != 0"))


@query(
    "cold_start_trust", "JOI18",
    f"""WITH {OQ}, pj AS (SELECT DISTINCT user_id AS project, user_id % 7 AS industry FROM events), us AS (SELECT DISTINCT user_id AS project, task_type FROM s WHERE user_id % 15 <> 0), m AS (SELECT task_type, sum(trust_pct)::DOUBLE / count(*) / 100 AS mean FROM oq GROUP BY 1)
SELECT DISTINCT industry, task_type, least(mean, 0.6::DOUBLE) AS trust FROM us JOIN pj USING (project) JOIN m USING (task_type)""",
)
def cold_start_trust(spark, d):
    used = concepts.session_log(spark, d).filter("user_id % 15 != 0").select(F.col("user_id").alias("project"), "task_type").distinct()
    return S.cold_start_trust(_projects(spark, d), used, _quality(spark, d).select("task_type", "trust_pct"))


# --- retention and baselines ---------------------------------------------------------------


@query(
    "retained_patterns", "WIN10",
    f"""WITH {CP}, p AS (SELECT session_id, task_type, ended, row_number() OVER (PARTITION BY task_type ORDER BY ended DESC, session_id) AS rn FROM cp) SELECT session_id, task_type FROM p WHERE rn <= 60 ORDER BY ended DESC, session_id LIMIT 150""",
)
def retained_patterns(spark, d):
    rows = S.context_patterns(concepts.session_log(spark, d)).select("session_id", "task_type", "ended")
    return ordered.retained(rows, ["task_type"], [F.desc("ended"), F.col("session_id")], per_key=60, total=150).select("session_id", "task_type")


@query(
    "decayed_baselines", "WIN6",
    f"""WITH {OQ}, b AS (SELECT task_type || '-' || (CAST(string_split(session_id, '-')[1] AS BIGINT) % 20) AS task, max(ended) AS lc, max(trust_pct)::DOUBLE / 100 AS trust FROM oq GROUP BY 1)
SELECT task, trust, CASE WHEN date_diff('day', CAST(lc AS DATE), DATE '2024-01-31') > 14 AND trust > 0.4 THEN greatest(0.4::DOUBLE, trust - 0.03::DOUBLE) ELSE trust END AS new_trust FROM b""",
)
def decayed_baselines(spark, d):
    oq = _quality(spark, d)
    task = F.concat_ws("-", "task_type", (F.split("session_id", "-")[0].cast("long") % 20).cast("string"))
    baselines = oq.groupBy(task.alias("task")).agg(F.max("ended").alias("last_calibrated"), (F.max("trust_pct") / 100).alias("trust"))
    return ordered.decay_baselines(baselines, F.lit("2024-01-31").cast("date")).select("task", "trust", "new_trust")


@query(
    "unprocessed_sessions", "TOP10",
    f"WITH {PF} SELECT session_id, CAST(sum(reads) AS BIGINT) AS files_read, CAST(sum(writes) AS BIGINT) AS files_written FROM pf WHERE user_id % 3 <> 0 GROUP BY session_id HAVING sum(writes) >= 1",
)
def unprocessed_sessions(spark, d):
    log = concepts.session_log(spark, d)
    done = log.filter("user_id % 3 = 0").select("session_id").distinct()
    counts = log.groupBy("session_id").agg(F.count_if(F.col("tool") == "Read").alias("files_read"), F.count_if(F.col("tool").isin(S.WRITES)).alias("files_written"))
    return counts.filter("files_written >= 1").join(done, "session_id", "left_anti")


@query(
    "base_recommendations", "TOP11",
    """WITH g AS (SELECT o_custkey AS project, count(*) AS generations FROM orders GROUP BY 1), p AS (SELECT c_custkey AS project, c_mktsegment AS industry, (greatest(0.0, least(100.0, floor(c_acctbal / 100))))::DOUBLE AS quality, coalesce(generations, 0) AS generations FROM customer LEFT JOIN g ON project = c_custkey),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY industry ORDER BY quality DESC, generations, project) AS INT) AS rn FROM p)
SELECT industry, project, quality, generations, rn, 1.0::DOUBLE * 0.7::DOUBLE + quality / 100.0::DOUBLE * 0.3::DOUBLE AS score, CASE WHEN rn = 1 THEN 'base' WHEN rn <= 3 THEN 'alternative' ELSE 'candidate' END AS place FROM r WHERE rn <= 5""",
)
def base_recommendations(spark, d):
    gens = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("generations"))
    quality = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(F.col("c_acctbal") / 100).cast("double")))
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("industry"), quality.alias("quality"))
    rows = cust.join(gens, "project", "left").withColumn("generations", F.coalesce("generations", F.lit(0).cast("long")))
    return S.recommend_base(rows).select("industry", "project", "quality", "generations", "rn", "score", "place")


@query("sessions_per_week", "FUN6", f"SELECT {C.WEEK} AS week, count(*) AS events FROM events GROUP BY 1")
def sessions_per_week(spark, d):
    return table(spark, d, "events").groupBy(epoch_week(concepts.epoch_seconds(F.col("ts"))).alias("week")).agg(F.count("*").alias("events"))


@query(
    "learning_health", "AGG59",
    f"""WITH {USES}, per AS (SELECT session_id, max(ts) AS ended, min(ts) AS started, count(*) FILTER (WHERE tool IN ('Write', 'Edit')) AS writes FROM s GROUP BY 1),
one AS (SELECT count(*) AS a, sum(writes) AS b, count(*) FILTER (WHERE started > TIMESTAMP '2024-01-24') AS c, count(*) FILTER (WHERE started < TIMESTAMP '2024-01-24' AND writes = 0) AS d, max(ended) AS l FROM per)
SELECT 'total_sessions' AS stat, CAST(a AS VARCHAR) AS value FROM one UNION ALL SELECT 'total_writes', CAST(b AS VARCHAR) FROM one UNION ALL SELECT 'recent_sessions', CAST(c AS VARCHAR) FROM one UNION ALL SELECT 'stale_sessions', CAST(d AS VARCHAR) FROM one
UNION ALL SELECT 'last_session', strftime(l, '%Y-%m-%d') FROM one UNION ALL SELECT 'status', CASE WHEN a = 0 OR c = 0 THEN 'stalled' ELSE 'healthy' END FROM one UNION ALL SELECT 'facts_learned', CAST(count(*) AS VARCHAR) FROM us
UNION ALL SELECT 'blessed_conventions', CAST(count(*) FILTER (WHERE times_seen >= 10) AS VARCHAR) FROM us UNION ALL SELECT 'projects_learned', CAST(count(DISTINCT project) AS VARCHAR) FROM us""",
)
def learning_health(spark, d):
    facts = _uses(spark, d).withColumn("blessed", F.col("times_seen") >= 10)
    return S.health_snapshot(concepts.session_log(spark, d), facts, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
