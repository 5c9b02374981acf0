"""Queries over feedback: rule confidence, tuning, A/B tests, calibration, fixes, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions import scores
from siftmill.operators import incremental, metrics, ordered, ranking
from siftmill.plans import concept_sql as C
from siftmill.plans.findings_plans import NOW, _now
from siftmill.plans.registry import query
from siftmill.plans.scan_plans import PART_RULES_CTE, part_rules
from siftmill.sources import concepts, rules as R
from siftmill.sources.tables import table


def _state(spark, d):
    state = metrics.rule_state(concepts.feedback(spark, d))
    return metrics.with_confidence(state.withColumn("severity", concepts.rule_severity(F.col("rule_id"))))


@query("rule_confidence", "AGG9", f"WITH {C.STATE} SELECT rule_id, total_hits, true_positives, false_positives, severity, confidence, effective_severity FROM state")
def rule_confidence(spark, d):
    return _state(spark, d).select("rule_id", "total_hits", "true_positives", "false_positives", "severity", "confidence", "effective_severity")


@query(
    "rules_to_disable", "AGG10",
    f"WITH {C.STATE} SELECT rule_id, confidence, 'FP rate ' || CAST(floor(false_positives::DOUBLE / total_hits * 100 + 0.5) AS BIGINT) || '%' AS reason FROM state WHERE confidence < 0.5 AND total_hits >= 10",
)
def rules_to_disable(spark, d):
    return metrics.noisy_to_disable(_state(spark, d), threshold=0.5).select("rule_id", "confidence", "reason")


@query("noisiest_rules", "AGG11", f"WITH {C.STATE} SELECT rule_id, total_hits, false_positives, confidence, effective_severity FROM state WHERE false_positives >= 3 ORDER BY confidence, rule_id LIMIT 20")
def noisiest_rules(spark, d):
    return metrics.noisiest(_state(spark, d)).select("rule_id", "total_hits", "false_positives", "confidence", "effective_severity")


@query("merged_hit_counters", "AGG12 WIN5", f"WITH {C.STATE} SELECT rule_id, total_hits, true_positives, false_positives, fix_success, fix_failure, strftime(last_hit, '%Y-%m-%d') AS last_hit FROM st0")
def merged_hit_counters(spark, d):
    # Counters up to 1999 are the stored state; later feedback is merged into it.
    fb = concepts.feedback(spark, d)
    cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    old, new = (metrics.rule_state(fb.filter(c)) for c in (F.col("ts") < cut, F.col("ts") >= cut))
    return metrics.merge_hits(old, new).withColumn("last_hit", F.date_format("last_hit", "yyyy-MM-dd"))


@query(
    "rule_metrics", "AGG13",
    f"""WITH {C.STATE} SELECT rule_id, CASE WHEN true_positives + false_positives > 0 THEN true_positives::DOUBLE / (true_positives + false_positives) ELSE 0 END AS precision,
 true_positives::DOUBLE / total_hits AS recall, fix_success::DOUBLE / (fix_success + fix_failure) AS fix_rate, false_positives::DOUBLE / total_hits AS fp_rate FROM state""",
)
def rule_metrics(spark, d):
    return metrics.rule_metrics(_state(spark, d)).select("rule_id", "precision", "recall", "fix_rate", "fp_rate")


@query(
    "tuning_decisions", "AGG14 FUN9",
    f"""WITH {C.STATE}, m AS (SELECT *, CASE WHEN true_positives + false_positives > 0 THEN true_positives::DOUBLE / (true_positives + false_positives) ELSE 0 END AS p, false_positives::DOUBLE / total_hits AS f,
 CASE effective_severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'SUGGEST' END AS down FROM state),
x AS (SELECT *, CASE WHEN p < 0.5 THEN 'disable' WHEN p < 0.7 AND f > 0.3 AND down IS NOT NULL THEN 'demote' ELSE 'none' END AS action FROM m)
SELECT rule_id, effective_severity, action, CASE WHEN action = 'demote' THEN down END AS new_severity FROM x""",
)
def tuning_decisions(spark, d):
    return metrics.tuning_decision(metrics.rule_metrics(_state(spark, d))).select("rule_id", "effective_severity", "action", "new_severity")


@query(
    "feedback_confidence", "AGG16",
    f"""WITH {C.STATE} SELECT rule_id, (fix_success - 2 * false_positives)::DOUBLE / 100 AS adjustment,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence + (fix_success - 2 * false_positives)::DOUBLE / 100)) AS new_confidence FROM state""",
)
def feedback_confidence(spark, d):
    return metrics.feedback_confidence(_state(spark, d)).select("rule_id", "adjustment", "new_confidence")


AB_SQL = """WITH r AS (SELECT l_suppkey % 100 AS test_id, CASE l_linenumber % 2 WHEN 1 THEN 'baseline' ELSE 'variant' END AS version, l_orderkey AS scan_id,
 count(*) FILTER (WHERE l_returnflag = 'A') AS tp, count(*) FILTER (WHERE l_returnflag = 'R') AS fp, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 25) AS fn,
 count(*) FILTER (WHERE l_linestatus = 'F') AS ok, count(*) FILTER (WHERE l_linestatus <> 'F') AS bad FROM lineitem GROUP BY ALL),
m AS (SELECT test_id, version, count(*) AS scans, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(ok) AS ok, sum(bad) AS bad FROM r GROUP BY ALL),
k AS (SELECT test_id, version, scans, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS rc, ok::DOUBLE / (ok + bad) AS fx, (2 * tp)::DOUBLE / (2 * tp + fp + fn) AS f1 FROM m),
j AS (SELECT b.test_id, b.scans AS bs, v.scans AS vs, b.p AS bp, v.p AS vp, b.rc AS br, v.rc AS vr, b.fx AS bf, v.fx AS vf, b.f1 AS b1, v.f1 AS v1 FROM k b JOIN k v ON b.test_id = v.test_id AND b.version = 'baseline' AND v.version = 'variant')
SELECT test_id, bs AS baseline_scans, vs AS variant_scans, bp AS baseline_precision, vp AS variant_precision, br AS baseline_recall, vr AS variant_recall, bf AS baseline_fix_rate, vf AS variant_fix_rate,
 b1 AS baseline_f1, v1 AS variant_f1, CASE WHEN bs >= 20 AND vs >= 20 THEN CASE WHEN abs(b1 - v1) < 0.05 THEN 'tie' WHEN v1 > b1 THEN 'variant' ELSE 'baseline' END END AS winner,
 CASE WHEN bs >= 20 AND vs >= 20 THEN CASE WHEN abs(b1 - v1) < 0.05 THEN 1.0::DOUBLE - abs(b1 - v1) / 0.05::DOUBLE ELSE least(1.0::DOUBLE, abs(b1 - v1) / 0.2::DOUBLE) END ELSE 0 END AS confidence FROM j"""


@query("ab_test_winners", "AGG15", AB_SQL)
def ab_test_winners(spark, d):
    flag = F.col("l_returnflag")
    results = (
        table(spark, d, "lineitem")
        .groupBy((F.col("l_suppkey") % 100).alias("test_id"), F.when(F.col("l_linenumber") % 2 == 1, "baseline").otherwise("variant").alias("version"), F.col("l_orderkey").alias("scan_id"))
        .agg(
            F.count_if(flag == "A").alias("true_positives"), F.count_if(flag == "R").alias("false_positives"),
            F.count_if((flag == "N") & (F.col("l_quantity") > 25)).alias("false_negatives"),
            F.count_if(F.col("l_linestatus") == "F").alias("fix_success"), F.count_if(F.col("l_linestatus") != "F").alias("fix_failure"),
        )
    )
    out = metrics.ab_winner(metrics.ab_metrics(results), target_scans=20)
    names = [f"{v}_{m}" for m in ("scans", "precision", "recall", "fix_rate", "f1") for v in ("baseline", "variant")]
    return out.select("test_id", *names, "winner", "confidence")


# --- dismissal texts -----------------------------------------------------------------------

DISMISS = "dis AS (SELECT conv_id % 5 AS rule_id, 'c' || conv_id AS file, text AS reason FROM conversations WHERE role <> 'system')"
PHRASES = f"""{DISMISS}, w AS (SELECT rule_id, file, list_filter(string_split_regex(lower(reason), '\\s+'), lambda x: x <> '') AS ws FROM dis),
said AS (SELECT rule_id, file, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: array_to_string(list_slice(ws, i, i + 2), ' '))) AS phrase FROM w),
ph AS (SELECT rule_id, phrase, count(*) AS "count", count(DISTINCT file) AS files, list_slice(list_sort(list_distinct(list(file))), 1, 3) AS example_files FROM said GROUP BY ALL HAVING count(*) >= 2)"""


def _dismissals(spark, d):
    return table(spark, d, "conversations").filter("role != 'system'").select(
        (F.col("conv_id") % 5).alias("rule_id"), F.concat(F.lit("c"), "conv_id").alias("file"), F.col("text").alias("reason")
    )


@query("dismiss_phrases", "AGG17", f"""WITH {PHRASES} SELECT rule_id, phrase, "count", files, array_to_string(example_files, ',') AS example_files FROM ph""")
def dismiss_phrases(spark, d):
    return metrics.dismiss_phrases(_dismissals(spark, d), min_occurrences=2).withColumn("example_files", F.array_join("example_files", ","))


@query(
    "rules_needing_tuning", "AGG18",
    f"""WITH {PHRASES}, t AS (SELECT rule_id, count(*) AS dismissals FROM dis GROUP BY rule_id HAVING count(*) >= 5), top AS (SELECT rule_id, max({{'c': "count", 'p': phrase}}) AS top FROM ph GROUP BY rule_id)
SELECT t.rule_id, dismissals, top.p AS phrase, coalesce(top.c, 0) AS "count", coalesce(top.c::DOUBLE / dismissals >= 0.8, false) AS dominant FROM t LEFT JOIN top USING (rule_id)""",
)
def rules_needing_tuning(spark, d):
    dis = _dismissals(spark, d)
    return metrics.rules_needing_tuning(metrics.dismiss_phrases(dis, min_occurrences=2), dis)


@query(
    "tune_suggestions", "FUN23",
    f"""WITH {PHRASES} SELECT suggestion, count(*) AS phrases FROM (SELECT CASE
 WHEN contains(phrase, 'already') AND contains(phrase, 'called') THEN 'exclude-parent-call' WHEN contains(phrase, 'false positive') AND contains(phrase, 'comment') THEN 'exclude-comments'
 WHEN contains(phrase, 'test') OR contains(phrase, 'mock') THEN 'exclude-tests' WHEN contains(phrase, 'third party') OR contains(phrase, 'vendor') THEN 'exclude-vendor'
 WHEN contains(phrase, 'intentional') OR contains(phrase, 'by design') THEN 'relax'
 WHEN len(list_filter(example_files, lambda f: NOT contains(lower(f), 'test'))) = 0 THEN 'all-in-tests' WHEN len(list_filter(example_files, lambda f: NOT contains(f, 'vendor'))) = 0 THEN 'all-in-vendor'
 ELSE 'review' END AS suggestion FROM ph) GROUP BY suggestion""",
)
def tune_suggestions(spark, d):
    from siftmill.functions.text import tune_suggestion

    ph = metrics.dismiss_phrases(_dismissals(spark, d), min_occurrences=2)
    return ph.groupBy(tune_suggestion(F.col("phrase"), F.col("example_files")).alias("suggestion")).agg(F.count("*").alias("phrases"))


DOCFB = "fbdoc AS (SELECT source AS rule_id, text AS match_text, toxic = 1 AS is_fp FROM documents JOIN labels USING (doc_id))"


def _doc_feedback(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("rule_id"), F.col("text").alias("match_text"))
    return docs.join(table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_fp")), "doc_id")


@query(
    "common_fp_tokens", "AGG19",
    f"""WITH {DOCFB}, dd AS (SELECT * FROM fbdoc WHERE is_fp), n AS (SELECT rule_id, count(*) AS dismissals FROM dd GROUP BY rule_id),
t AS (SELECT rule_id, token, count(*) AS n FROM (SELECT rule_id, unnest(regexp_extract_all(lower(match_text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM dd) GROUP BY ALL)
SELECT rule_id, token, t.n, dismissals FROM t JOIN n USING (rule_id) WHERE t.n >= dismissals * 0.5""",
)
def common_fp_tokens(spark, d):
    return metrics.common_fp_tokens(_doc_feedback(spark, d).filter("is_fp"))


@query(
    "pattern_accuracy", "AGG20",
    f"""WITH {DOCFB} SELECT rule_id, count(*) AS samples,
 count(*) FILTER (WHERE is_fp <> regexp_matches(match_text, '[A-Z][a-z]+'))::DOUBLE / count(*) AS accuracy_before,
 count(*) FILTER (WHERE is_fp <> (regexp_matches(match_text, '[A-Z][a-z]+') AND NOT regexp_matches(match_text, '[!?]')))::DOUBLE / count(*) AS accuracy_after FROM fbdoc GROUP BY rule_id""",
)
def pattern_accuracy(spark, d):
    samples = _doc_feedback(spark, d).withColumnRenamed("match_text", "text")
    # The refined pattern carries a look-ahead for the excluded tokens, on the whole text.
    return metrics.pattern_accuracy(samples, {"before": r"[A-Z][a-z]+", "after": r"(?s)^(?!.*[!?]).*[A-Z][a-z]+"}, "rule_id")


FAIL = "fl AS (SELECT lang AS rule_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE CASE doc_id % 3 WHEN 0 THEN 'SyntaxError' WHEN 1 THEN 'ImportError' ELSE 'TypeError' END || ' ' || (length(text) % 5) || chr(10) || text END AS message FROM documents)"


@query(
    "failure_analysis", "AGG23",
    f"""WITH {FAIL}, c AS (SELECT rule_id, CASE WHEN message = '' THEN 'Unknown' ELSE string_split(message, chr(10))[1] END AS error_type, count(*) AS n FROM fl GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, error_type) AS rn, CAST(sum(n) OVER (PARTITION BY rule_id) AS BIGINT) AS total_failures FROM c)
SELECT rule_id, error_type, n, rn, total_failures, total_failures::DOUBLE / (total_failures + 10) AS failure_rate, contains(lower(error_type), 'syntax') AS is_syntax,
 contains(lower(error_type), 'import') AS is_import, contains(lower(error_type), 'type') AS is_type FROM r WHERE rn <= 5""",
)
def failure_analysis(spark, d):
    did = F.col("doc_id")
    kind = F.when(did % 3 == 0, "SyntaxError").when(did % 3 == 1, "ImportError").otherwise("TypeError")
    message = F.when(did % 9 == 0, "").otherwise(F.concat(kind, F.lit(" "), F.length("text") % 5, F.lit("\n"), F.col("text")))
    return metrics.failure_analysis(table(spark, d, "documents").select(F.col("lang").alias("rule_id"), message.alias("message")))


@query(
    "fix_risk", "AGG24 FUN8",
    """WITH f AS (SELECT doc_id, lang, text, len(string_split(text, chr(10))) AS lines, n_chars FROM documents), r AS (SELECT lang, count(*) AS failures FROM documents WHERE doc_id % 7 = 0 GROUP BY lang),
br AS (SELECT doc_id, string_split(regexp_replace(text, '[^\\[\\]{}()]', '', 'g'), '') AS cs FROM f), ch AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM br),
su AS (SELECT doc_id, i, sum(CASE WHEN c IN ('{', '[', '(') THEN 1 WHEN c IN ('}', ']', ')') THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM ch),
n AS (SELECT doc_id, max(l) AS nest FROM (SELECT doc_id, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS l FROM su) GROUP BY doc_id),
p AS (SELECT f.doc_id, failures::DOUBLE / (failures + 10) AS lesson,
 (CASE WHEN n_chars > 10000 THEN 0.8 WHEN n_chars > 5000 THEN 0.5 ELSE 0.2 END)::DOUBLE AS file,
 (CASE WHEN lines > 100 THEN 0.9 WHEN lines > 50 THEN 0.7 WHEN lines > 20 THEN 0.5 WHEN lines > 10 THEN 0.3 ELSE 0.1 END)::DOUBLE AS size,
 (CASE WHEN nest > 4 THEN 30 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)preg_match|preg_replace|regex') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)SELECT|INSERT|UPDATE|DELETE') THEN 20 ELSE 0 END
  + CASE WHEN regexp_matches(text, 'function\\s*\\(|=>\\s*\\{') THEN 10 ELSE 0 END)::DOUBLE / 100 AS syntax,
 (CASE WHEN regexp_matches(text, '(?i)import |require|include|use ') THEN 0.6 ELSE 0.0 END)::DOUBLE AS deps FROM f JOIN r USING (lang) JOIN n USING (doc_id)),
s AS (SELECT doc_id, (CASE WHEN lesson > 0.3 THEN lesson * 0.3::DOUBLE ELSE 0 END) + (CASE WHEN file > 0.5 THEN file * 0.2::DOUBLE ELSE 0 END) + (CASE WHEN size > 0.5 THEN size * 0.2::DOUBLE ELSE 0 END)
 + (CASE WHEN syntax > 0.5 THEN syntax * 0.15::DOUBLE ELSE 0 END) + (CASE WHEN deps > 0.5 THEN deps * 0.15::DOUBLE ELSE 0 END) AS risk FROM p)
SELECT doc_id, floor(risk * 1e9 + 0.5) / 1e9 AS risk_score, CASE WHEN risk >= 0.75 THEN 'CRITICAL' WHEN risk >= 0.5 THEN 'HIGH' WHEN risk >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s""",
)
def fix_risk(spark, d):
    from siftmill.functions.text import fix_risk_score, risk_level

    docs = table(spark, d, "documents")
    failures = docs.filter("doc_id % 7 = 0").groupBy("lang").agg(F.count("*").alias("failures"))
    risk = fix_risk_score(F.col("text"), F.col("n_chars"), F.col("failures"), size_limits=(10_000, 5_000))
    # One row per language; a join by language would send all texts of one to one task.
    return docs.join(F.broadcast(failures), "lang").select("doc_id", risk.alias("r")).select(
        "doc_id", (F.floor(F.col("r") * 1e9 + 0.5) / 1e9).alias("risk_score"), risk_level(F.col("r")).alias("risk_level")
    )


@query(
    "verdict_consensus", "AGG25",
    """WITH vd AS (SELECT l_partkey AS rule_id, l_suppkey % 20 AS file, CASE l_returnflag WHEN 'A' THEN 'confirm' WHEN 'R' THEN 'reject' ELSE 'unsure' END AS verdict, (0.5 + l_discount)::DECIMAL(9,4) AS c FROM lineitem),
p AS (SELECT rule_id, file, verdict, count(*) AS n, sum(c) AS conf FROM vd GROUP BY ALL), t AS (SELECT rule_id, file, CAST(sum(n) AS BIGINT) AS agents, max({'n': n, 'conf': conf, 'v': verdict}) AS top FROM p GROUP BY ALL),
s AS (SELECT rule_id, file, top.v AS consensus, (top.n::DOUBLE / agents) * (top.conf::DOUBLE / top.n) AS confidence, agents, top.n AS tn FROM t)
SELECT rule_id, file, consensus, confidence, agents, confidence < 0.7 OR (agents > 1 AND tn = 1) AS needs_human FROM s""",
)
def verdict_consensus(spark, d):
    flag = F.col("l_returnflag")
    verdicts = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("rule_id"), (F.col("l_suppkey") % 20).alias("file"),
        F.when(flag == "A", "confirm").when(flag == "R", "reject").otherwise("unsure").alias("verdict"), (0.5 + F.col("l_discount")).cast("decimal(9,4)").alias("confidence"),
    )
    return metrics.consensus(verdicts, "rule_id", "file")


@query(
    "rollback_rates", "AGG26",
    f"""WITH {C.FIXES} SELECT rule_id, count(*) FILTER (WHERE rolled_back) AS rollbacks, count(*) AS fixes, strftime(max(CASE WHEN rolled_back THEN ts END), '%Y-%m-%d') AS last_rollback,
 count(*) FILTER (WHERE rolled_back)::DOUBLE / count(*) AS rollback_rate FROM fixes GROUP BY rule_id HAVING count(*) FILTER (WHERE rolled_back) >= 3 ORDER BY rollback_rate DESC, rollbacks DESC, rule_id LIMIT 20""",
)
def rollback_rates(spark, d):
    return metrics.rollback_rates(concepts.fixes(spark, d)).withColumn("last_rollback", F.date_format("last_rollback", "yyyy-MM-dd"))


# --- decay and quarantine ------------------------------------------------------------------


@query(
    "confidence_decay", "WIN3",
    f"""WITH {C.STATE}, x AS (SELECT rule_id, confidence, date_diff('day', CAST(last_hit AS DATE), DATE '{NOW}') AS days FROM state),
y AS (SELECT rule_id, days, greatest(days // 30, 0) AS p, list_reduce(range(greatest(days // 30, 0)), lambda c, i: c - c * 0.1::DOUBLE, confidence) AS v FROM x)
SELECT rule_id, CAST(days AS INT) AS days_since_hit, CAST(p AS INT) AS decay_periods, coalesce(v, 0) AS new_confidence, p > 0 AND v < 0.5 AS needs_review FROM y""",
)
def confidence_decay(spark, d):
    out = ordered.decayed(_state(spark, d), F.lit(NOW).cast("date"))
    return out.select("rule_id", "days_since_hit", "decay_periods", "new_confidence", "needs_review")


@query("stale_rules", "WIN4", f"WITH {C.STATE} SELECT rule_id, confidence, CAST(date_diff('day', CAST(last_hit AS DATE), DATE '{NOW}') AS INT) AS days_since_hit FROM state WHERE confidence < 0.5")
def stale_rules(spark, d):
    return ordered.stale_rules(_state(spark, d), F.lit(NOW).cast("date")).select("rule_id", "confidence", "days_since_hit")


@query("decay_reset", "WIN5", f"WITH {C.STATE} SELECT rule_id, strftime(greatest(last_hit, TIMESTAMP '2001-01-01'), '%Y-%m-%d') AS last_hit FROM state")
def decay_reset(spark, d):
    # New hits: every rule is seen once on 2001-01-01.
    hits = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    out = ordered.reset_decay(_state(spark, d), hits.join(_state(spark, d).select("rule_id"), "rule_id", "left_semi"))
    return out.withColumn("last_hit", F.date_format("last_hit", "yyyy-MM-dd"))


@query(
    "quarantined_rules", "WIN14",
    f"""WITH p AS (SELECT l_partkey AS rule_id, max(l_shipdate) AS promoted_at, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS clean_scans FROM lineitem GROUP BY 1)
SELECT rule_id, clean_scans, NOT (TIMESTAMP '{NOW}' >= promoted_at + INTERVAL 7 DAY AND clean_scans >= 5) AS quarantined FROM p""",
)
def quarantined_rules(spark, d):
    promoted = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("rule_id")).agg(
        F.max("l_shipdate").alias("promoted_at"), F.count_if((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("clean_scans")
    )
    return ordered.quarantined(promoted, _now()).select("rule_id", "clean_scans", "quarantined")


@query("rate_limited_templates", "WIN15", "SELECT l_suppkey % 10 AS bucket, l_suppkey AS template, strftime(max(l_shipdate), '%Y-%m-%d') AS last_patch FROM lineitem GROUP BY ALL HAVING max(l_shipdate) > TIMESTAMP '2001-10-15' - INTERVAL 24 HOUR")
def rate_limited_templates(spark, d):
    patches = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("bucket"), F.col("l_suppkey").alias("template"), F.col("l_shipdate").alias("ts"))
    out = ordered.rate_limited(patches, ["bucket", "template"], F.lit("2001-10-15 00:00:00").cast("timestamp_ntz"))
    return out.withColumn("last_patch", F.date_format("last_patch", "yyyy-MM-dd"))


# --- components and generated files --------------------------------------------------------


@query(
    "mined_components", "AGG47",
    f"""WITH {C.DETECTIONS}, g AS (SELECT component_type, count(*) AS o, count(accepted) AS j, count(*) FILTER (WHERE accepted) AS y, sum(confidence_pct) AS c FROM det WHERE confidence >= 0.5 GROUP BY 1),
s AS (SELECT component_type, max({{'n': n, 's': snippet}}) AS top FROM (SELECT component_type, snippet, count(*) AS n FROM det GROUP BY ALL) GROUP BY 1)
SELECT component_type, o AS occurrences, y::DOUBLE / j AS acceptance_rate, c::DOUBLE / o / 100 AS avg_confidence, top.s AS example, top.n AS example_count, y::DOUBLE / j >= 0.8 AND o >= 5 AS add_to_templates
FROM g JOIN s USING (component_type) WHERE o >= 3 AND j > 0 AND y::DOUBLE / j >= 0.7""",
)
def mined_components(spark, d):
    return metrics.mined_components(concepts.detections(spark, d))


@query(
    "component_accuracy", "AGG48",
    f"""WITH {C.DETECTIONS}, c AS (SELECT component_type, count(*) AS sample_size, count(*) FILTER (WHERE auto_applied AND accepted) AS tp, count(*) FILTER (WHERE auto_applied AND NOT accepted) AS fp,
 count(*) FILTER (WHERE NOT auto_applied AND accepted) AS fn, count(*) FILTER (WHERE NOT auto_applied AND NOT accepted) AS tn FROM det WHERE accepted IS NOT NULL GROUP BY 1)
SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, (2 * tp)::DOUBLE / (2 * tp + fp + fn) AS f1 FROM c""",
)
def component_accuracy(spark, d):
    return metrics.confusion(concepts.detections(spark, d), "component_type")


GRID = [0.5, 0.6, 0.7, 0.8, 0.9]


@query(
    "best_threshold", "AGG49",
    f"""WITH {C.DETECTIONS}, f AS (SELECT * FROM det WHERE accepted IS NOT NULL), c AS (SELECT component_type, t, count(*) AS rows, count(*) FILTER (WHERE confidence >= t AND accepted) AS tp,
 count(*) FILTER (WHERE confidence >= t AND NOT accepted) AS fp, count(*) FILTER (WHERE confidence < t AND accepted) AS fn FROM f, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS t) GROUP BY ALL),
g AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY component_type ORDER BY f1 DESC, t) AS rn FROM g)
SELECT component_type, rows, t AS threshold, f1, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, tp::DOUBLE / (tp + fn) AS recall FROM r WHERE rn = 1""",
)
def best_threshold(spark, d):
    return metrics.best_threshold(concepts.detections(spark, d), "confidence", "accepted", GRID, "component_type")


@query(
    "component_statistics", "AGG50",
    f"""WITH {C.DETECTIONS} SELECT coalesce(component_type, '(all)') AS component_type, count(*) AS detected, count(*) FILTER (WHERE auto_applied) AS applied, count(*) FILTER (WHERE accepted) AS accepted,
 sum(confidence_pct)::DOUBLE / count(*) AS avg_confidence_pct FROM det WHERE accepted IS NOT NULL GROUP BY ROLLUP (component_type)""",
)
def component_statistics(spark, d):
    return metrics.pattern_stats(concepts.detections(spark, d))


@query(
    "generation_quality", "AGG51",
    f"""WITH {C.GENERATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, gen_id DESC, template DESC) AS rn, count(*) OVER (PARTITION BY project) AS n FROM gens),
a AS (SELECT project, count(*) AS total_files, sum(quality_pct) AS q, sum(fix_count) AS f, sum(violations_at_gen) AS v, avg(quality_pct) FILTER (WHERE rn <= n // 2) AS recent, avg(quality_pct) FILTER (WHERE rn > n // 2) AS older FROM r GROUP BY project)
SELECT project, total_files, CAST(f AS BIGINT) AS fix_count, CAST(v AS BIGINT) AS violations_at_gen, q::DOUBLE / total_files / 100 AS quality, CASE WHEN total_files < 4 THEN 'stable' WHEN recent > older + 1 THEN 'improving' WHEN recent < older - 1 THEN 'degrading' ELSE 'stable' END AS trend FROM a""",
)
def generation_quality(spark, d):
    return ranking.generation_quality(concepts.generations(spark, d), margin_pct=1)


@query(
    "high_risk_templates", "AGG52",
    f"WITH {C.GENERATIONS} SELECT template, CAST(sum(fix_count) AS BIGINT) AS total_fixes, sum(quality_pct)::DOUBLE / count(*) AS avg_quality_pct, count(*) AS generations FROM gens GROUP BY template ORDER BY total_fixes DESC, template LIMIT 5",
)
def high_risk_templates(spark, d):
    return metrics.high_risk_templates(concepts.generations(spark, d))


@query(
    "learned_fixes", "AGG53",
    f"""WITH {C.FIXES}, p AS (SELECT rule_id, fix_type, count(*) AS n, max(ts) AS ts FROM fixes WHERE verified AND NOT rolled_back GROUP BY ALL)
SELECT rule_id, fix_type, n AS applied_count FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, ts DESC, fix_type DESC) AS rn FROM p) WHERE rn = 1""",
)
def learned_fixes(spark, d):
    return metrics.learned_fix(concepts.fixes(spark, d))


@query(
    "golden_patterns", "AGG55",
    """SELECT l_linestatus AS pattern_type, l_partkey AS pattern_name, count(*) AS usage_count, CAST(sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS BIGINT) AS bug_count, count(DISTINCT l_suppkey) AS projects, count(*) >= 14 AS auto_apply
FROM lineitem GROUP BY ALL HAVING count(*) >= 3 AND sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) = 0""",
)
def golden_patterns(spark, d):
    uses = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("pattern_type"), F.col("l_partkey").alias("pattern_name"), F.col("l_suppkey").alias("project"), F.when(F.col("l_tax") > 0.07, 1).otherwise(0).alias("bugs")
    )
    return metrics.golden_patterns(uses, 3, 14)


@query(
    "fixed_generations", "WIN12",
    f"""WITH {C.GENERATIONS}, l AS (SELECT *, row_number() OVER (PARTITION BY project, template ORDER BY ts DESC, gen_id DESC) AS rn FROM gens), f AS (SELECT l_partkey AS project, l_suppkey AS template, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT project, template, gen_id, fix_count + coalesce(n, 0) AS fix_count, greatest(0, quality_pct - 10 * coalesce(n, 0)) AS quality_pct FROM l LEFT JOIN f USING (project, template) WHERE rn = 1""",
)
def fixed_generations(spark, d):
    fixes = concepts.fixes(spark, d).filter("rolled_back").select(F.col("rule_id").alias("project"), F.col("file").alias("template"))
    return ordered.fixes_on_latest(concepts.generations(spark, d), fixes, ["project", "template"])


@query(
    "component_detections", "TOP4",
    f"WITH {C.DETECTIONS} SELECT component_type, confidence, snippet, gen_id, line, strftime(ts, '%Y-%m-%d') AS date FROM det WHERE confidence >= 0.8 AND component_type = 'hero' AND accepted ORDER BY ts DESC, gen_id, line, snippet, confidence LIMIT 100",
)
def component_detections(spark, d):
    rows = ranking.component_detections(concepts.detections(spark, d), min_confidence=0.8, component_type="hero", accepted=True, limit=100)
    return rows.select("component_type", "confidence", "snippet", "gen_id", "line", F.date_format("ts", "yyyy-MM-dd").alias("date"))


# --- suggestions ---------------------------------------------------------------------------

SUG = "sug AS (SELECT l_partkey AS id, p_name AS pattern, p_type AS pattern_type, l_suppkey AS project, CASE l_returnflag WHEN 'N' THEN 'pending' WHEN 'A' THEN 'approved' ELSE 'rejected' END AS status, count(*) AS times_seen FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _suggestions(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    flag = F.col("l_returnflag")
    seen = li.groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("project"), F.when(flag == "N", "pending").when(flag == "A", "approved").otherwise("rejected").alias("status")).agg(F.count("*").alias("times_seen"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("pattern"), F.col("p_type").alias("pattern_type"))
    return seen.join(names, "id")


@query("pending_suggestions", "TOP7", f"WITH {SUG} SELECT id, pattern, pattern_type, project, times_seen FROM sug WHERE status = 'pending' ORDER BY times_seen DESC, id, project LIMIT 10")
def pending_suggestions(spark, d):
    return ranking.pending_suggestions(_suggestions(spark, d)).select("id", "pattern", "pattern_type", "project", "times_seen")


@query("promotable_patterns", "TOP8", f"WITH {SUG} SELECT id, pattern, project, times_seen, row_number() OVER (ORDER BY times_seen DESC, id, project) <= 2 AS this_run FROM sug WHERE status <> 'approved' AND times_seen >= 2 ORDER BY times_seen DESC, id, project LIMIT 10")
def promotable_patterns(spark, d):
    return ranking.promotable_patterns(_suggestions(spark, d).filter("status != 'approved'"), min_seen=2).select("id", "pattern", "project", "times_seen", "this_run")


@query(
    "new_suggestions", "SET5 JOI12",
    """WITH cat AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS pattern, 'T' || lang || (doc_id % 40) AS title FROM documents),
ex AS (SELECT trim(string_split(text, chr(10))[1]) AS pattern, 'tEN' || (item_id % 12) || ' ' AS title FROM benchmark)
SELECT doc_id, title FROM cat WHERE pattern NOT IN (SELECT pattern FROM ex) AND lower(trim(title)) NOT IN (SELECT lower(trim(title)) FROM ex)""",
)
def new_suggestions(spark, d):
    first = F.trim(F.split("text", "\n", 2)[0])
    cat = table(spark, d, "documents").select("doc_id", first.alias("pattern"), F.concat(F.lit("T"), "lang", F.col("doc_id") % 40).alias("title"))
    existing = table(spark, d, "benchmark").select(first.alias("pattern"), F.concat(F.lit("tEN"), F.col("item_id") % 12, F.lit(" ")).alias("title"))
    return incremental.new_suggestions(cat, existing).select("doc_id", "title")


@query(
    "catalog_gaps", "JOI12",
    """WITH cat AS (SELECT lang AS language, trim(string_split(text, chr(10))[1]) AS pattern FROM documents), ex AS (SELECT DISTINCT trim(string_split(text, chr(10))[1]) AS pattern FROM benchmark)
SELECT language, count(*) AS entries, count(*) FILTER (WHERE ex.pattern IS NULL) AS gaps, count(*) FILTER (WHERE ex.pattern IS NOT NULL) AS covered FROM cat LEFT JOIN ex USING (pattern) GROUP BY language""",
)
def catalog_gaps(spark, d):
    first = F.trim(F.split("text", "\n", 2)[0])
    cat = table(spark, d, "documents").select(F.col("lang").alias("language"), first.alias("pattern"), F.lit("").alias("title"))
    existing = table(spark, d, "benchmark").select(first.alias("pattern"), F.lit("").alias("title"))
    gaps = incremental.new_suggestions(cat, existing).select("language", F.lit(1).alias("gap"))
    total = cat.select("language", F.lit(0).alias("gap"))
    return gaps.unionByName(total).groupBy("language").agg(F.count_if(F.col("gap") == 0).alias("entries"), F.count_if(F.col("gap") == 1).alias("gaps")).withColumn(
        "covered", F.col("entries") - F.col("gaps")
    )


UPS = """raw AS (SELECT p_name AS pattern, CASE l_returnflag WHEN 'N' THEN 'pending' ELSE 'approved' END AS status, 1 AS frequency, 0.5 + l_discount * 5 AS confidence, l_suppkey AS example, l_shipdate AS ts FROM lineitem JOIN part ON l_partkey = p_partkey),
ups AS (SELECT pattern, status, count(*) AS frequency, max(ts) AS ts, max({'ts': ts, 'example': example, 'confidence': confidence}) AS latest FROM raw GROUP BY ALL)"""


def _raw_suggestions(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_discount", "l_suppkey", "l_shipdate")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("pattern"))
    return li.join(names, "l_partkey").select(
        "pattern", F.when(F.col("l_returnflag") == "N", "pending").otherwise("approved").alias("status"), F.lit(1).cast("long").alias("frequency"),
        (0.5 + F.col("l_discount") * 5).alias("confidence"), F.struct(F.col("l_suppkey").alias("example"), (0.5 + F.col("l_discount") * 5).alias("confidence")).alias("example"), F.col("l_shipdate").alias("ts"),
    )


@query("upserted_suggestions", "SET6", f"WITH {UPS} SELECT pattern, status, frequency, latest.confidence::DOUBLE AS confidence, latest.example AS example, strftime(ts, '%Y-%m-%d') AS ts FROM ups")
def upserted_suggestions(spark, d):
    raw = _raw_suggestions(spark, d)
    cut = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    out = incremental.upsert_suggestions(raw.filter(F.col("ts") < cut), raw.filter(F.col("ts") >= cut))
    return out.select("pattern", "status", "frequency", "confidence", F.col("example.example").alias("example"), F.date_format("ts", "yyyy-MM-dd").alias("ts"))


@query(
    "promotion_outcomes", "SET7",
    f"""WITH {UPS}, a AS (SELECT count(*) AS approved FROM ups WHERE status = 'approved') SELECT outcome, count(*) AS candidates FROM (SELECT CASE WHEN (SELECT approved FROM a) < 10 THEN 'skipped_gate' WHEN latest.confidence < 0.8 THEN 'skipped_confidence'
 WHEN frequency < 300 THEN 'skipped_frequency' ELSE 'promoted' END AS outcome FROM ups WHERE status = 'pending') GROUP BY outcome""",
)
def promotion_outcomes(spark, d):
    raw = _raw_suggestions(spark, d)
    all_rows = incremental.upsert_suggestions(raw, raw.limit(0))
    # The gate is one number.
    approved = all_rows.filter("status = 'approved'").count()
    out = incremental.promotion_outcome(all_rows.filter("status = 'pending'"), F.lit(approved), min_approved=10, min_frequency=300)
    return out.groupBy("outcome").agg(F.count("*").alias("candidates"))


# --- calibration of scores -----------------------------------------------------------------

SCORED = "sc AS (SELECT l_suppkey % 50 AS tool, CAST(40 + l_quantity AS INT) AS score_given, CASE WHEN l_returnflag = 'A' THEN 'good' WHEN l_returnflag = 'R' THEN 'bad' END AS outcome, l_shipdate AS ts, l_orderkey AS id, l_linenumber AS ln, l_partkey AS pk FROM lineitem)"


def _scored(spark, d):
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("tool"), (40 + F.col("l_quantity")).cast("int").alias("score_given"),
        F.when(flag == "A", "good").when(flag == "R", "bad").alias("outcome"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"),
    )


@query(
    "score_calibration", "AGG45",
    f"""WITH {SCORED}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts DESC, id, ln, pk) AS rn FROM sc WHERE outcome IS NOT NULL) WHERE rn <= 200)
SELECT tool, count(*) AS total, count(*) FILTER (WHERE (score_given >= 70) = (outcome = 'good'))::DOUBLE / count(*) * 100 AS accuracy, count(*) FILTER (WHERE score_given >= 80 AND outcome = 'bad') AS overconfident,
 count(*) FILTER (WHERE score_given < 50 AND outcome = 'good') AS underconfident, CASE WHEN count(*) FILTER (WHERE (score_given >= 70) = (outcome = 'good'))::DOUBLE / count(*) > 0.7 THEN 'good' ELSE 'needs_adjustment' END AS calibration FROM l GROUP BY tool""",
)
def score_calibration(spark, d):
    return ranking.score_calibration(_scored(spark, d), ["tool"], [F.desc("ts"), "id", "ln", "pk"])


@query(
    "adaptive_weights", "AGG46",
    f"""WITH {SCORED}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts DESC, id, ln, pk) AS rn FROM sc WHERE outcome IS NOT NULL) WHERE rn <= 50),
a AS (SELECT tool, count(*) AS n, count(*) FILTER (WHERE score_given >= 80 AND outcome = 'bad')::DOUBLE / count(*) AS o, count(*) FILTER (WHERE score_given < 50 AND outcome = 'good')::DOUBLE / count(*) AS u FROM l GROUP BY tool),
w(k, x) AS (VALUES ('coverage', 0.4::DOUBLE), ('relevance', 0.3::DOUBLE), ('completeness', 0.3::DOUBLE))
SELECT tool, k AS dimension, CASE WHEN n < 5 THEN x WHEN o > 0.15 THEN x * 0.85::DOUBLE WHEN u > 0.15 THEN least(1.0::DOUBLE, x * 1.15::DOUBLE) ELSE x END AS weight FROM a, w""",
)
def adaptive_weights(spark, d):
    defaults = {"coverage": 0.4, "relevance": 0.3, "completeness": 0.3}
    return ranking.adaptive_weights(_scored(spark, d), ["tool"], [F.desc("ts"), "id", "ln", "pk"], defaults, limit_share=0.15)


# --- ranking of rules ----------------------------------------------------------------------

RANK_SQL = f"""WITH {PART_RULES_CTE}, {C.STATE}, h AS (SELECT l_partkey AS rule_id, count(*) AS history FROM lineitem WHERE l_shipdate >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY GROUP BY 1),
x AS (SELECT r.rule_id, r.severity, r.category, CASE r.severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 20 ELSE 10 END + CASE WHEN r.category IN ('small', 'large') THEN 25 ELSE 0 END
 + least(5 * len(list_intersect(list_distinct(list_transform(r.tags, lambda t: lower(t))), ['both', 'economy', 'small'])), 15) + CASE WHEN contains(r.description, 'ring') THEN 30 ELSE 0 END
 + coalesce(least(h.history * 3, 15), 0) + coalesce(CAST(trunc((s.confidence - 0.5) * 20) AS BIGINT), 0) AS score
 FROM rules r LEFT JOIN h ON h.rule_id = CAST(r.rule_id AS BIGINT) LEFT JOIN state s ON s.rule_id = CAST(r.rule_id AS BIGINT) WHERE r.severity IN ('CRITICAL', 'HIGH'))
SELECT rule_id, severity, category, score FROM x ORDER BY score DESC, rule_id LIMIT 25"""


@query("ranked_rules", "TOP5 FUN5", RANK_SQL)
def ranked_rules(spark, d):
    rules = R.with_defaults(part_rules(spark, d))
    history = (
        table(spark, d, "lineitem").filter(F.col("l_shipdate") >= _now() - F.expr("INTERVAL 400 DAYS"))
        .groupBy(F.col("l_partkey").cast("string").alias("rule_id")).agg(F.count("*").alias("history"))
    )
    conf = _state(spark, d).select(F.col("rule_id").cast("string").alias("rule_id"), "confidence")
    return ranking.ranked_rules(
        rules, history, conf, categories=["small", "large"], keywords=["both", "economy", "small"], signal=F.col("description").contains("ring"), limit=25
    )


@query(
    "search_quality", "AGG67 AGG68 FUN10",
    f"""WITH {PART_RULES_CTE}, r AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE contains(lower(description), 'ring')) AS m FROM rules GROUP BY category),
x AS (SELECT category, n, least(100, CAST(floor(m::DOUBLE / n * 100) AS BIGINT) + 20) AS relevance, least(100, n * 15) AS coverage FROM r)
SELECT category, relevance, coverage, CAST(trunc(relevance * 0.6::DOUBLE + coverage * 0.4::DOUBLE) AS INT) AS score, CASE WHEN relevance * 6 + coverage * 4 >= 900 THEN 'TRUST' WHEN relevance * 6 + coverage * 4 >= 700 THEN 'USE_WITH_CARE' WHEN relevance * 6 + coverage * 4 >= 500 THEN 'REVIEW' ELSE 'UNRELIABLE' END AS label,
 CAST(trunc(least(100, n // 4) * 0.3::DOUBLE + 100 * 0.4::DOUBLE + CASE WHEN n < 5 THEN 60 ELSE 100 END * 0.3::DOUBLE) AS INT) AS scan_score FROM x""",
)
def search_quality(spark, d):
    return ranking.search_quality(R.with_defaults(part_rules(spark, d)), "category", "ring")
