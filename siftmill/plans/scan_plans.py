"""Rule evaluation: corpora, scopes, suppression, presence, absence and cross checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import incremental, metrics, rulescan, scan
from siftmill.plans import sqltext as q
from siftmill.plans.registry import query
from siftmill.sources import corpus, rules as R, sinks
from siftmill.sources.rules import Guard, Rule
from siftmill.sources.tables import table

# --- the rules the example scans use -------------------------------------------------------

PROSE_RULES = [
    Rule("license-text", r"(?i)licen[sc]e|copyright", "HIGH", "compliance", description="License text"),
    Rule("contact-sign", r"@", "CRITICAL", "privacy", description="Contact sign", exclude_line=r"@@"),
    Rule("secret-word", r"(?i)secret|token|password|api[_-]?key", "CRITICAL", "security", description="Secret word"),
    Rule("shouting", r"[!?]{2,}", "SUGGEST", "style", description="Repeated marks"),
]
CODE_RULES = [
    Rule("credential", r"(password|secret)\s*=\s*['\"]", "CRITICAL", "php-security", description="Credential in code",
         scope="themes/**/*.php|themes/**/*.py"),
    Rule("raw-input", r"\$_(GET|POST)\[", "HIGH", "php-security", description="Unfiltered input",
         exclude_line=r"sanitize|nonce"),
    Rule("debug-call", r"console\.(log|debug|info)\(|var_dump\(", "SUGGEST", "code-quality",
         description="Debug output", max_per_file=2),
    Rule("echo-variable", r"echo\s+\$", "CRITICAL", "php-security", description="Echo of a variable",
         context_guard=Guard(r"sanitize|esc_", 3, 0)),
    Rule("eval-call", r"\beval\s*\(", "HIGH", "php-security", description="eval", dedup="per_file",
         exclude="tests/*|*functions*"),
    Rule("stock-write", r"\$stock\s*-=", "HIGH", "db-schema", description="Stock write", exclude_path="vendor",
         context_guard=Guard(r"TRANSACTION", 5, 5)),
]


def _re_in_scope(rule: Rule) -> str:
    cond = "true"
    if rule.scope not in ("**/*", ""):
        cond += f" AND regexp_matches(path, {q.lit(R.scope_regex(rule.scope))})"
    if rule.exclude:
        cond += f" AND NOT regexp_matches(path, {q.lit(R.exclude_regex(rule.exclude))})"
    if rule.exclude_path:
        cond += f" AND NOT contains(path, {q.lit(rule.exclude_path)})"
    return cond


def ignored_sql(line: str, rule_id: str) -> str:
    tag = scan.IGNORE_TAG
    return (
        f"(contains({line}, {q.lit(tag + ' ' + rule_id)}) OR contains({line}, {q.lit(tag + ' all')}) "
        f"OR regexp_matches({line}, '#\\s*nosec\\b\\s*($|[^:\\s])') "
        f"OR regexp_matches({line}, {q.lit('#' + chr(92) + 's*nosec' + chr(92) + 's*:' + chr(92) + 's*' + re.escape(rule_id))}))"
    )


def file_ignored_sql(lines: str, rule_id: str) -> str:
    tag = scan.IGNORE_TAG
    return (
        f"path IN (SELECT path FROM {lines} WHERE line_no <= 10 AND (contains(line, {q.lit(tag + ' ' + rule_id)}) "
        f"OR contains(line, {q.lit(tag + ' all')})))"
    )


def presence_sql(lines: str, rules, width: int = 120, default_cap: int = 0) -> str:
    """Independent SQL of a presence scan: windows over exploded lines."""
    parts = []
    for r in rules:
        cap = 1 if r.dedup == "per_file" else (r.max_per_file or default_cap)
        g = r.context_guard
        context = (
            f"string_agg(line, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {g.lines_before} "
            f"PRECEDING AND {g.lines_after} FOLLOWING)"
            if g
            else "''"
        )
        cond = f"regexp_matches(line, {q.lit(r.pattern)}) AND NOT {ignored_sql('line', r.rule_id)}"
        if r.exclude_line:
            cond += f" AND NOT regexp_matches(line, {q.lit(r.exclude_line)})"
        if g:
            cond += f" AND NOT regexp_matches(ctx, {q.lit(g.pattern)})"
        parts.append(
            f"""SELECT project, {q.lit(r.rule_id)} AS rule_id, {q.lit(r.severity)} AS severity,
       {q.lit(r.category)} AS category, {q.lit(r.description)} AS description, path, line_no,
       substr(trim(line, chr(32) || chr(9)), 1, {width}) AS match_text
FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn
      FROM (SELECT *, {context} AS ctx FROM {lines} WHERE {_re_in_scope(r)}
            AND NOT {file_ignored_sql(lines, r.rule_id)}) w WHERE {cond}) h
{f'WHERE rn <= {cap}' if cap else ''}"""
        )
    return "\nUNION ALL\n".join(parts)


def prose_hits(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_presence(corpus.spread(corpus.document_files(spark, d)), PROSE_RULES)


def code_hits(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_presence(corpus.code_files(spark, d), CODE_RULES)


HITS_CTE = q.DOC_LINES_CTE + ",\nhits AS MATERIALIZED (\n" + presence_sql("doc_lines", PROSE_RULES) + ")"
CODE_HITS_CTE = q.CODE_LINES_CTE + ",\nhits AS MATERIALIZED (\n" + presence_sql("code_lines", CODE_RULES) + ")"


# --- sources -------------------------------------------------------------------------------


@query(
    "corpus_files_by_language", "SRC1 SRC5",
    q.with_code(
        """SELECT project, lang, ext, count(*) AS files, sum(len(lines)) AS lines, sum(length(content)) AS chars
FROM code WHERE NOT regexp_matches(path, '(^|/)(node_modules|\\.git|vendor|__pycache__|\\.next|dist|build|\\.turbo|out)(/|$)')
GROUP BY ALL"""
    ).replace("sum(len(lines))", "CAST(sum(len(lines)) AS BIGINT)").replace("sum(length(content))", "CAST(sum(length(content)) AS BIGINT)"),
)
def corpus_files_by_language(spark, d):
    files = corpus.code_files(spark, d).filter(~corpus.excluded_path(F.col("path")))
    return (
        corpus.with_lines(files)
        .groupBy("project", "lang", "ext")
        .agg(
            F.count("*").alias("files"),
            F.sum(F.size("lines").cast("long")).alias("lines"),
            F.sum(F.length("content").cast("long")).alias("chars"),
        )
    )


@query(
    "numbered_lines", "SRC2",
    q.with_docs(
        """SELECT project, count(*) AS lines, max(line_no) AS longest, CAST(sum(line_no * length(line)) AS BIGINT) AS weight,
count(*) FILTER (WHERE line = '') AS blank FROM doc_lines GROUP BY project"""
    ),
)
def numbered_lines(spark, d):
    lines = corpus.explode_lines(corpus.document_files(spark, d))
    return lines.groupBy("project").agg(
        F.count("*").alias("lines"),
        F.max("line_no").alias("longest"),
        F.sum((F.col("line_no") * F.length("line")).cast("long")).alias("weight"),
        F.count_if(F.col("line") == "").alias("blank"),
    )


def part_rules(spark: SparkSession, d: str) -> DataFrame:
    """The part table read as a rule table: name is the pattern, brand the category."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    none = F.lit(None).cast("string")
    tags = F.array(
        F.when(size % 3 == 0, "theme").when(size % 3 == 1, "plugin").otherwise("both"),
        F.lower("p_type"),
    )
    return p.select(
        F.col("p_partkey").cast("string").alias("rule_id"),
        F.when(size % 10 < 2, "CRITICAL").when(size % 10 < 6, "HIGH").when(size % 10 < 8, "SUGGEST").when(size % 10 == 8, "INFO").alias("severity"),
        F.lower("p_type").alias("category"),
        F.when(size % 4 == 0, "absence").when(size % 4 == 1, "presence").when(size % 4 == 2, "manual").alias("type"),
        F.col("p_name").alias("description"),
        tags.alias("tags"),
        F.when(size % 5 == 0, "both").when(size % 5 == 1, "wp").when(size % 5 == 2, "nextjs").alias("platform"),
        F.when(size % 7 != 0, F.col("p_name")).alias("pattern"),
        F.when(size % 6 == 0, F.lit("themes/**/*.php | themes/*/inc/*.php|packages/x")).when(size % 6 == 1, F.lit("src/**/*.js"))
        .when(size % 6 == 2, F.lit("themes/*/inc/*.php|inc/*.php")).alias("scope"),
        F.when(size % 8 == 0, F.array(F.lit("store"), F.lit("react"))).when(size % 8 == 1, F.array(F.lit("next"))).alias("requires"),
        F.when(size % 9 == 0, F.array(F.lit("store"))).alias("conflicts"),
        none.alias("disabled_reason"),
        F.col("p_brand").alias("body"),
        F.col("p_retailprice").alias("price"),
    )


PART_RULES_CTE = """
raw_rules AS (
  SELECT CAST(p_partkey AS VARCHAR) AS rule_id,
   CASE WHEN p_size % 10 < 2 THEN 'CRITICAL' WHEN p_size % 10 < 6 THEN 'HIGH' WHEN p_size % 10 < 8 THEN 'SUGGEST' WHEN p_size % 10 = 8 THEN 'INFO' END AS severity,
   lower(p_type) AS category,
   CASE p_size % 4 WHEN 0 THEN 'absence' WHEN 1 THEN 'presence' WHEN 2 THEN 'manual' END AS type,
   p_name AS description,
   [CASE p_size % 3 WHEN 0 THEN 'theme' WHEN 1 THEN 'plugin' ELSE 'both' END, lower(p_type)] AS tags,
   CASE p_size % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'wp' WHEN 2 THEN 'nextjs' END AS platform,
   CASE WHEN p_size % 7 <> 0 THEN p_name END AS pattern,
   CASE p_size % 6 WHEN 0 THEN 'themes/**/*.php | themes/*/inc/*.php|packages/x' WHEN 1 THEN 'src/**/*.js'
     WHEN 2 THEN 'themes/*/inc/*.php|inc/*.php' END AS scope,
   CASE p_size % 8 WHEN 0 THEN ['store', 'react'] WHEN 1 THEN ['next'] ELSE [] END AS requires,
   CASE WHEN p_size % 9 = 0 THEN ['store'] ELSE [] END AS conflicts,
   p_brand AS body, p_retailprice AS price
  FROM part),
rules AS (
  SELECT rule_id, coalesce(severity, 'HIGH') AS severity, category, coalesce(type, 'presence') AS type, description, tags,
         platform, pattern, coalesce(scope, '**/*') AS scope, requires, conflicts, body, price
  FROM raw_rules WHERE pattern IS NOT NULL AND coalesce(type, 'presence') NOT IN ('block', 'pattern', 'manual'))"""


@query(
    "rule_table", "SRC3",
    f"WITH {PART_RULES_CTE} SELECT rule_id, severity, category, type, description, scope, array_to_string(tags, ',') AS tags FROM rules",
)
def rule_table(spark, d):
    return R.with_defaults(part_rules(spark, d)).select(
        "rule_id", "severity", "category", "type", "description", "scope", F.array_join("tags", ",").alias("tags")
    )


SCOPES = {
    "php": ("themes/**/*.php", None),
    "inc-php": ("themes/*/inc/**", None),
    "js-no-vendor": ("**/*.js|**/*.ts", "vendor/*|**/vendor/*"),
    "one-folder": ("themes/src3", "*CartView*"),
}


@query(
    "scoped_files", "SRC4",
    q.with_code(
        "\nUNION ALL\n".join(
            f"SELECT {q.lit(k)} AS scope_name, project, count(*) AS files FROM code WHERE regexp_matches(path, {q.lit(R.scope_regex(s))})"
            + (f" AND NOT regexp_matches(path, {q.lit(R.exclude_regex(e))})" if e else "")
            + " GROUP BY project"
            for k, (s, e) in SCOPES.items()
        )
    ),
)
def scoped_files(spark, d):
    path = F.col("path")
    named = F.array_compact(
        F.array(*[F.when(R.in_scope(path, Rule(k, "", scope=s, exclude=e)), F.lit(k)) for k, (s, e) in SCOPES.items()])
    )
    files = corpus.code_files(spark, d)
    return files.select("project", F.explode(named).alias("scope_name")).groupBy("scope_name", "project").agg(
        F.count("*").alias("files")
    )


@query(
    "rewritten_scopes", "SRC6 FIL10",
    f"""WITH {PART_RULES_CTE}, parts AS (
 SELECT rule_id, scope, list_transform(string_split(scope, '|'), lambda p: trim(p)) AS ps FROM rules)
SELECT rule_id, scope,
 array_to_string(list_transform(list_filter(list_transform(ps, lambda p, i: {{'v': regexp_replace(p, '^themes/\\*\\*?/', ''), 'i': i}}),
   lambda s: list_position(list_transform(ps, lambda p: regexp_replace(p, '^themes/\\*\\*?/', '')), s.v) = s.i), lambda s: s.v), '|') AS rewritten,
 len(list_filter(ps, lambda p: p <> '' AND NOT regexp_matches(p, '^(packages/|shared/|themes/|mu-plugins/)'))) = 0
   AND len(list_filter(ps, lambda p: p <> '')) > 0 AS root_level
FROM parts""",
)
def rewritten_scopes(spark, d):
    rules = R.with_defaults(part_rules(spark, d))
    return rules.select(
        "rule_id", "scope", R.rewrite_scope(F.col("scope")).alias("rewritten"), R.is_root_level(F.col("scope")).alias("root_level")
    )


# Snapshot = the corpus as it was before the documents of two sources were edited and those of
# one source were added.
def _snapshot(files: DataFrame) -> DataFrame:
    edited = F.when(F.col("project").isin("src1", "src2"), F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    return files.filter(F.col("project") != "src3").select("project", "path", edited.alias("content"))


@query(
    "changed_files", "SRC7",
    "SELECT source AS project, 'doc-' || doc_id AS path, sha256(text) AS sha256 FROM documents WHERE source IN ('src1', 'src2', 'src3')",
)
def changed_files(spark, d):
    files = corpus.document_files(spark, d)
    old = incremental.content_hashes(_snapshot(files))
    return incremental.changed_files(incremental.content_hashes(files), old).select("project", "path", "sha256")


SCAN_ROW_SQL = f"""WITH {HITS_CTE}
SELECT d.project, count(DISTINCT d.path) AS files_scanned, {len(PROSE_RULES)} AS patterns_checked,
 (SELECT count(*) FROM hits h WHERE h.project = d.project) AS violations_total,
 (SELECT count(*) FROM hits h WHERE h.project = d.project AND severity = 'CRITICAL') AS violations_critical,
 (SELECT count(*) FROM hits h WHERE h.project = d.project AND severity = 'HIGH') AS violations_high,
 (SELECT count(*) FROM hits h WHERE h.project = d.project AND severity = 'SUGGEST') AS violations_suggest
FROM docs d GROUP BY d.project"""


@query("scan_history_rows", "SRC8", SCAN_ROW_SQL)
def scan_history_rows(spark, d):
    files = corpus.document_files(spark, d)
    return sinks.scan_rows(prose_hits(spark, d), files, len(PROSE_RULES))


@query(
    "violation_rows", "SRC9",
    f"WITH {HITS_CTE} SELECT rule_id, path, line_no, match_text, severity, category, '2024-01-01' AS scan_date, CAST(7 AS BIGINT) AS scan_id FROM hits",
)
def violation_rows(spark, d):
    rows = sinks.violation_rows(prose_hits(spark, d), scan_id=7, detected_at="2024-01-01 00:00:00")
    return rows.select("rule_id", "path", "line_no", "match_text", "severity", "category",
                       F.date_format("scan_date", "yyyy-MM-dd").alias("scan_date"), "scan_id")


@query(
    "grouped_report", "SRC10 AGG2 WIN1",
    f"""WITH {HITS_CTE}, n AS (
 SELECT *, count(*) OVER (PARTITION BY rule_id) AS total, row_number() OVER (PARTITION BY rule_id ORDER BY path, line_no) AS rn FROM hits)
SELECT rule_id, severity, description, total AS "count", least(total, 5) AS shown, greatest(total - 5, 0) AS hidden_by_cap,
 rn, path AS file, line_no AS line, match_text AS "match" FROM n WHERE rn <= 5""",
)
def grouped_report(spark, d):
    return sinks.grouped_report(prose_hits(spark, d), max_per_rule=5)


@query(
    "project_capabilities", "SRC11",
    q.with_code(
        """SELECT project, array_to_string(list_sort(list_distinct(list(cap))), ',') AS capabilities FROM (
 SELECT project, CASE WHEN regexp_matches(content, 'from ''react''') THEN 'react' END AS cap FROM code
 UNION ALL SELECT project, CASE WHEN regexp_matches(content, '\\bload_item_[a-z0-9_]+\\s*\\(') THEN 'items' END FROM code
 UNION ALL SELECT project, CASE WHEN regexp_matches(path, '/inc/.*functions\\.php$') THEN 'theme' END FROM code
 UNION ALL SELECT project, CASE WHEN regexp_matches(content, 'axios\\.get') AND regexp_matches(path, 'CartView') THEN 'cart' END FROM code)
WHERE cap IS NOT NULL GROUP BY project"""
    ),
)
def project_capabilities(spark, d):
    files = corpus.code_files(spark, d)
    c, p = F.col("content"), F.col("path")
    markers = {
        "react": c.rlike("from 'react'"),
        "items": c.rlike(r"\bload_item_[a-z0-9_]+\s*\("),
        "theme": p.rlike(r"/inc/.*functions\.php$"),
        "cart": c.rlike(r"axios\.get") & p.rlike("CartView"),
    }
    caps = metrics.project_capabilities(files, markers)
    return caps.select("project", F.array_join("capabilities", ",").alias("capabilities"))


# --- filters -------------------------------------------------------------------------------


@query(
    "rules_by_severity", "FIL1",
    f"""WITH {PART_RULES_CTE} SELECT 'ALL' AS wanted, rule_id FROM rules WHERE severity <> 'INFO'
UNION ALL SELECT 'INFO', rule_id FROM rules WHERE severity = 'INFO' UNION ALL SELECT 'CRITICAL', rule_id FROM rules WHERE severity = 'CRITICAL'""",
)
def rules_by_severity(spark, d):
    rules = R.with_defaults(part_rules(spark, d))
    parts = [R.severity_filter(rules, w).select(F.lit(w).alias("wanted"), "rule_id") for w in ("ALL", "INFO", "CRITICAL")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "rules_by_platform", "FIL2",
    f"WITH {PART_RULES_CTE} SELECT rule_id, platform, category FROM rules WHERE coalesce(platform, '') IN ('both', 'wp') OR category IN ('economy', 'small')",
)
def rules_by_platform(spark, d):
    rules = R.with_defaults(part_rules(spark, d))
    return R.platform_filter(rules, "wp", ["economy", "small"]).select("rule_id", "platform", "category")


@query(
    "rules_by_stack", "FIL3",
    f"""WITH {PART_RULES_CTE} SELECT rule_id FROM rules WHERE (len(requires) = 0 OR list_has_any(requires, ['react', 'php']))
AND NOT list_has_any(conflicts, ['react', 'php'])""",
)
def rules_by_stack(spark, d):
    caps = F.array(F.lit("react"), F.lit("php"))
    return R.stack_filter(R.with_defaults(part_rules(spark, d)), caps).select("rule_id")


@query(
    "rules_by_scope_type", "FIL4",
    f"WITH {PART_RULES_CTE} SELECT rule_id FROM rules WHERE list_contains(tags, 'theme') OR list_contains(tags, 'both')",
)
def rules_by_scope_type(spark, d):
    return R.scope_type_filter(R.with_defaults(part_rules(spark, d)), "theme").select("rule_id")


@query(
    "enabled_rules", "FIL5",
    f"""WITH {PART_RULES_CTE}, noisy AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS fp FROM lineitem GROUP BY 1)
SELECT rule_id FROM rules WHERE CAST(rule_id AS BIGINT) NOT IN (SELECT l_partkey FROM noisy WHERE fp * 5 > n * 2)""",
)
def enabled_rules(spark, d):
    li = table(spark, d, "lineitem")
    noisy = (
        li.groupBy(F.col("l_partkey").cast("string").alias("rule_id"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("fp"))
        .filter(F.col("fp") * 5 > F.col("n") * 2)
    )
    return R.drop_disabled(R.with_defaults(part_rules(spark, d)), noisy).select("rule_id")


# Dismissals derived from the labels: a label with quality 0 dismisses the file's hits of one
# rule, toxic labels of some projects dismiss a rule for the project.
def _dismissals(spark, d) -> DataFrame:
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    path = F.concat(F.lit("doc-"), F.col("doc_id"))
    none = F.lit(None).cast("string")
    file_scope = lab.filter("quality = 0").select(
        F.lit("shouting").alias("rule_id"), F.lit("file").alias("scope"), none.alias("project"), path.alias("path"), F.lit(True).alias("active")
    )
    project_scope = lab.filter("toxic = 1").select(
        F.lit("license-text").alias("rule_id"), F.lit("project").alias("scope"), F.col("source").alias("project"), none.alias("path"),
        (F.col("doc_id") % 3 == 0).alias("active"),
    )
    global_scope = lab.groupBy().agg(F.count_if(F.col("toxic") == 1).alias("n")).select(
        F.lit("contact-sign").alias("rule_id"), F.lit("global").alias("scope"), none.alias("project"), none.alias("path"), (F.col("n") > 0).alias("active")
    )
    return file_scope.unionByName(project_scope).unionByName(global_scope)


@query(
    "undismissed_violations", "FIL6",
    f"""WITH {HITS_CTE}, lab AS (SELECT l.*, source FROM labels l JOIN documents USING (doc_id))
SELECT rule_id, path, line_no FROM hits h WHERE NOT (rule_id = 'contact-sign' AND EXISTS (SELECT 1 FROM lab WHERE toxic = 1))
AND NOT (rule_id = 'license-text' AND project IN (SELECT source FROM lab WHERE toxic = 1 AND doc_id % 3 = 0))
AND NOT (rule_id = 'shouting' AND path IN (SELECT 'doc-' || doc_id FROM lab WHERE quality = 0))""",
)
def undismissed_violations(spark, d):
    return scan.drop_dismissed(prose_hits(spark, d), _dismissals(spark, d)).select("rule_id", "path", "line_no")


@query(
    "suppressed_lines", "FIL7 FIL8",
    q.with_code_lines(
        "\nUNION ALL\n".join(
            f"""SELECT {q.lit(r)} AS rule_id, lang, count(*) AS lines, count(*) FILTER (WHERE {ignored_sql('line', r)}) AS line_ignored,
 count(*) FILTER (WHERE {file_ignored_sql('code_lines', r)}) AS in_ignored_file FROM code_lines GROUP BY lang"""
            for r in ("debug-call", "credential")
        )
    ),
)
def suppressed_lines(spark, d):
    files = corpus.with_lines(corpus.code_files(spark, d))

    def counts(rule_id: str):
        ignored = F.filter("lines", lambda x: scan.line_ignored(x, rule_id))
        return F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.size("lines").cast("long").alias("lines"),
            F.size(ignored).cast("long").alias("line_ignored"),
            F.when(scan.file_ignored(F.col("lines"), rule_id), F.size("lines")).otherwise(0).cast("long").alias("in_ignored_file"),
        )

    rows = F.array(counts("debug-call"), counts("credential"))
    return files.select("lang", F.inline(rows)).groupBy("rule_id", "lang").agg(
        F.sum("lines").alias("lines"), F.sum("line_ignored").alias("line_ignored"), F.sum("in_ignored_file").alias("in_ignored_file")
    )


KEYWORD_SQL = f"""WITH {PART_RULES_CTE} SELECT rule_id, severity, category, description, scope FROM rules
WHERE severity = 'HIGH' AND (contains(lower(description || ' ' || pattern || ' ' || category), 'ring') OR contains(lower(body), 'ring'))
ORDER BY rule_id LIMIT 10"""


@query("rule_keyword_search", "FIL11", KEYWORD_SQL)
def rule_keyword_search(spark, d):
    rules = R.with_defaults(part_rules(spark, d))
    return R.keyword_search(rules, "Ring", severity="HIGH").select("rule_id", "severity", "category", "description", "scope")


# --- presence ------------------------------------------------------------------------------

SUMMARY_SQL = f"""WITH {HITS_CTE}
SELECT rule_id, severity, count(*) AS hits, count(DISTINCT path) AS files, count(DISTINCT project) AS projects, min(line_no) AS first_line
FROM hits GROUP BY rule_id, severity"""


@query("scan_summary", "SRC2 DET1 FIL7 FIL9 AGG1", SUMMARY_SQL)
def scan_summary(spark, d):
    return prose_hits(spark, d).groupBy("rule_id", "severity").agg(
        F.count("*").alias("hits"),
        F.countDistinct("path").alias("files"),
        F.countDistinct("project").alias("projects"),
        F.min("line_no").alias("first_line"),
    )


@query("prose_violations", "DET1 FIL9", f"WITH {HITS_CTE} SELECT * FROM hits")
def prose_violations(spark, d):
    return prose_hits(spark, d)


@query("code_violations", "DET1 DET2 DET3 FIL7 FIL8 FIL9 SRC4", f"WITH {CODE_HITS_CTE} SELECT * FROM hits")
def code_violations(spark, d):
    return code_hits(spark, d)


CAP_RULES = [
    Rule("marks", r"[!?]", "SUGGEST", "style", max_per_file=3),
    Rule("comma", r",", "SUGGEST", "style", dedup="per_file"),
]


@query("capped_per_file", "DET2", f"WITH {q.DOC_LINES_CTE} {presence_sql('doc_lines', CAP_RULES)}")
def capped_per_file(spark, d):
    return scan.scan_presence(corpus.spread(corpus.document_files(spark, d)), CAP_RULES)


GUARD_RULES = [
    Rule("marks-default-window", r"[!?]", "SUGGEST", "style", context_guard=Guard(r"(^|[ ,.])([Tt]he|[Ll]e|[Dd]er)[ ,.]")),
    Rule("marks-wide-window", r"[!?]", "SUGGEST", "style", context_guard=Guard(r"(?i)copyright|@|[0-9]{3}", 5, 5)),
]


@query("context_guard", "DET3", f"WITH {q.DOC_LINES_CTE} {presence_sql('doc_lines', GUARD_RULES)}")
def context_guard(spark, d):
    return scan.scan_presence(corpus.spread(corpus.document_files(spark, d)), GUARD_RULES)


@query(
    "cross_file_guard", "DET4",
    q.with_code(
        """, callers AS (SELECT project, path, n FROM (
  SELECT project, path, unnest(list_distinct(list_concat(
    list_transform(regexp_extract_all(content, 'get_template_part\\s*\\(\\s*[''"](?:[^''"]*/)?([^''"/]+)[''"]', 1), lambda x: x || '.php'),
    regexp_extract_all(content, '(?:include|require)\\s*\\(\\s*[''"](?:[^''"]*/)?([^''"/]+\\.php)[''"]', 1)))) AS n
  FROM code WHERE ext = '.php' AND regexp_matches(content, 'is_wp_error')))
SELECT project, path FROM code p WHERE ext = '.php' AND regexp_matches(path, 'template-parts|partials|components')
AND EXISTS (SELECT 1 FROM callers c WHERE c.project = p.project AND c.path <> p.path AND c.n = regexp_extract(p.path, '([^/]+)$', 1))"""
    ).replace("\n, callers", ", callers"),
)
def cross_file_guard(spark, d):
    return scan.guarded_partials(corpus.code_files(spark, d), "is_wp_error")


# --- absence -------------------------------------------------------------------------------

ABSENCE = Rule("needs-number", r"[0-9]", "HIGH", "style", description="No number", pre_check=r"[!?]", type="absence")


@query(
    "absence_per_file", "DET5",
    q.with_docs(
        """SELECT project, 'needs-number' AS rule_id, 'HIGH' AS severity, 'style' AS category, 'No number' AS description, path, 0 AS line_no,
 'Missing: [0-9]' AS match_text FROM doc_lines GROUP BY project, path
HAVING bool_or(regexp_matches(line, '[!?]')) AND NOT bool_or(regexp_matches(line, '[0-9]'))"""
    ),
)
def absence_per_file(spark, d):
    return scan.absence_per_file(corpus.document_files(spark, d), ABSENCE)


ANY_RULES = [
    Rule("some-license", r"(?i)all rights reserved", "HIGH", "compliance", scope_mode="any", type="absence"),
    Rule("some-contact", r"@[a-z]+\.(org|net)", "HIGH", "privacy", scope_mode="any", type="absence", pre_check=r"@"),
]


@query(
    "absence_anywhere", "DET6",
    q.with_docs(
        """SELECT project, 'some-license' AS rule_id, path, match_text FROM (SELECT project, '[NOT FOUND IN: **/*]' AS path, 'Missing: (?i)all rights reserved' AS match_text,
  bool_or(regexp_matches(line, '(?i)all rights reserved')) AS hit FROM doc_lines GROUP BY project) WHERE NOT hit
UNION ALL SELECT project, 'some-contact', '[NOT FOUND IN: **/*]', 'Missing: @[a-z]+\\.(org|net)' FROM (
 SELECT project, bool_or(pre AND hit) AS hit, bool_or(pre) AS pre FROM (SELECT project, path, bool_or(regexp_matches(line, '@')) AS pre,
  bool_or(regexp_matches(line, '@[a-z]+\\.(org|net)')) AS hit FROM doc_lines GROUP BY ALL) GROUP BY project) WHERE pre AND NOT hit"""
    ),
)
def absence_anywhere(spark, d):
    files = corpus.document_files(spark, d)
    a, b = (scan.absence_anywhere(files, r) for r in ANY_RULES)
    return a.unionByName(b).select("project", "rule_id", "path", "match_text")


EMPTY_RULES = [
    Rule("needs-styles", "x", "HIGH", "style", scope="themes/**/*.css"),
    Rule("needs-functions", "x", "HIGH", "style", scope="themes/*/inc/**/functions.php"),
    Rule("optional-styles", "x", "HIGH", "style", scope="themes/**/*.scss", skip_empty_scope=True),
    Rule("needs-account", "x", "CRITICAL", "security", scope="**/account-4.php"),
]


@query(
    "empty_scopes", "DET7",
    q.with_code(
        "\nUNION ALL\n".join(
            f"""SELECT project, {q.lit(r.rule_id)} AS rule_id, {q.lit('[NO FILES MATCHING: ' + r.scope + ']')} AS path FROM code GROUP BY project
HAVING NOT bool_or(regexp_matches(path, {q.lit(R.scope_regex(r.scope))}))"""
            for r in EMPTY_RULES if not r.skip_empty_scope
        )
    ),
)
def empty_scopes(spark, d):
    return scan.empty_scope(corpus.code_files(spark, d), EMPTY_RULES).select("project", "rule_id", "path")


REQUIRED = ["functions.php", "account-2.php", "style.css"]


@query(
    "required_files", "DET8",
    q.with_code(
        "\nUNION ALL\n".join(
            f"""SELECT project, {q.lit(p)} AS path, {q.lit('File does not exist: ' + p)} AS match_text FROM code GROUP BY project
HAVING NOT bool_or(regexp_extract(path, '([^/]+)$', 1) = {q.lit(p)})"""
            for p in REQUIRED
        )
    ),
)
def required_files(spark, d):
    relative = F.regexp_extract("path", r"([^/]+)$", 1)
    rule = Rule("root-file", "", "HIGH", "structure", scope="theme root")
    return scan.required_files(corpus.code_files(spark, d), REQUIRED, relative, rule).select("project", "path", "match_text")


@query(
    "byte_order_marks", "DET12",
    """SELECT source AS project, count(*) AS files, count(*) FILTER (WHERE doc_id % 5 = 0) AS with_bom FROM documents GROUP BY source""",
)
def byte_order_marks(spark, d):
    docs = table(spark, d, "documents")
    # Every fifth document is written with a mark, as an editor would leave it.
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return docs.groupBy(F.col("source").alias("project")).agg(
        F.count("*").alias("files"), F.count_if(scan.starts_with_bom(raw)).alias("with_bom")
    )


MUST_NOT = [Rule("no-comma", r",", "SUGGEST", "style", description="Comma"), Rule("no-marks", r"[!?]", "HIGH", "style", max_per_file=2)]


@query("must_not_exist", "DET13", f"WITH {q.DOC_LINES_CTE} {presence_sql('doc_lines', MUST_NOT, width=100, default_cap=10)}")
def must_not_exist(spark, d):
    return scan.scan_must_not_exist(corpus.spread(corpus.document_files(spark, d)), MUST_NOT)


# --- cross checks --------------------------------------------------------------------------

CROSS = Rule("fetch-needs-catch", r"\bfetch\(", "HIGH", "js-contract", cross_check=r"\.catch\(", scope="**/*.js")
CROSS_SCOPE = Rule("post-needs-nonce", r"\$_POST\[", "CRITICAL", "php-security", cross_check=r"load_item_7\(4096", scope="**/*.php")




@query(
    "cross_check_same_file", "DET9",
    f"""WITH {q.CODE_LINES_CTE}, hits AS ({presence_sql('code_lines', [CROSS])})
SELECT rule_id, project, path, min(line_no) AS line_no, arg_min(match_text, line_no) AS match_text FROM hits
WHERE path IN (SELECT path FROM code WHERE NOT regexp_matches(content, '\\.catch\\(')) GROUP BY ALL""",
)
def cross_check_same_file(spark, d):
    return scan.cross_check_same_file(corpus.code_files(spark, d), CROSS).select("rule_id", "project", "path", "line_no", "match_text")


@query(
    "cross_check_scope", "DET10",
    f"""WITH {q.CODE_LINES_CTE}, hits AS ({presence_sql('code_lines', [CROSS_SCOPE])})
SELECT rule_id, project, path, line_no, match_text FROM hits WHERE project NOT IN
 (SELECT project FROM code WHERE regexp_matches(path, '/inc/') AND regexp_matches(content, 'load_item_7\\(4096'))""",
)
def cross_check_scope(spark, d):
    target = F.col("path").rlike("/inc/")
    return scan.cross_check_scope(corpus.code_files(spark, d), CROSS_SCOPE, target).select("rule_id", "project", "path", "line_no", "match_text")


UNDEFINED = Rule("undefined-call", r"(?:load_item|save_order)_[0-9]+\(", "HIGH", "php-security", scope="**/*.php", ignore_matches=("save_order_3",))


@query(
    "undefined_references", "DET11",
    f"""WITH {q.CODE_LINES_CTE}, hits AS ({presence_sql('code_lines', [UNDEFINED])}),
h AS (SELECT *, rtrim(regexp_extract(match_text, '(?:load_item|save_order)_[0-9]+\\('), '(') AS symbol FROM hits),
known AS (SELECT DISTINCT project, unnest(regexp_extract_all(content, '[a-z_]+_[0-9]+')) AS symbol FROM code WHERE regexp_matches(path, '/tests/.*\\.php$')),
decl AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, 'function\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS symbol FROM code)
SELECT project, path, line_no, symbol FROM h WHERE symbol <> 'save_order_3' AND (project, symbol) NOT IN (SELECT project, symbol FROM known)
 AND (path, symbol) NOT IN (SELECT path, symbol FROM decl)""",
)
def undefined_references(spark, d):
    target = F.col("path").rlike(r"/tests/.*\.php$")
    out = scan.undefined_references(corpus.code_files(spark, d), UNDEFINED, target, r"[a-z_]+_[0-9]+")
    return out.select("project", "path", "line_no", "symbol")


# --- a whole rule table in one pass --------------------------------------------------------

SYLLABLES = "th an er in ou en ch de re on at es or ti st ng al it as is ar ve le nd ed la se ei un ie qu ss nt em ra io ur ro li ll ic ne hi ri ma ta ce me si co ho ge so ab lo".split()


def rule_of(kind: int, s: str) -> Rule:
    """One of twelve rules about a word stem: every check of a scan, with and without literals, caps, guards and case."""
    name, about = f"{kind:02d}-{s}", {"severity": ["CRITICAL", "HIGH", "SUGGEST"][kind % 3], "category": "prose", "description": f"Rule {kind} about {s}"}
    return [
        Rule(name, rf" {s}[a-z]+tion ", **about),
        Rule(name, rf"{s}[a-z]{{2,}}\.", max_per_file=3, **about),
        Rule(name, rf"(?i) {s}{s}[a-z]*,", dedup="per_file", **about),
        Rule(name, rf"{s}ent[aeiou]", context_guard=Guard("[!?]", 1, 1), **about),
        Rule(name, rf"{s}[aeiou]", pre_check=rf" {s}[a-z]", type="absence", **about),
        Rule(name, rf"{s}{s}[0-9]", scope_mode="any", type="absence", **about),
        Rule(name, rf" {s}er ", cross_check=rf"{s}ou", **about),
        Rule(name, rf" {s}in ", cross_check=rf"{s}{s}{s}", cross_check_scope="**/*", **about),
        Rule(name, rf"(?:{s}tion|{s}ment) [A-Z]", exclude_line=r"\.$", **about),
        Rule(name, rf"[A-Z]{s}[a-z]*[,;] {s}", **about),
        Rule(name, rf"{s}!", **about),
        Rule(name, rf"(?i)not {s}|no {s}", **about),
    ][kind]


def rule_range(n: int) -> list[Rule]:
    stems = [a + SYLLABLES[(7 * k + 3) % len(SYLLABLES)] for k, a in enumerate(SYLLABLES)]
    return [rule_of(i % 12, stems[i // 12]) for i in range(n)]


def rule_scan_sql(rules: list[Rule]) -> str:
    """Violations and files per rule, every rule by a query of its own."""
    parts = []
    for r in rules:
        m = lambda p: f"regexp_matches(line, {q.lit(p)})"
        if r.type == "absence" and r.scope_mode == "any":
            rows = f"SELECT project AS path FROM doc_lines GROUP BY project HAVING NOT bool_or({m(r.pattern)})"
        elif r.type == "absence":
            rows = f"SELECT path FROM doc_lines GROUP BY path HAVING bool_or({m(r.pre_check)}) AND NOT bool_or({m(r.pattern)})"
        elif r.cross_check_scope:
            rows = f"SELECT path FROM doc_lines WHERE {m(r.pattern)} AND project NOT IN (SELECT project FROM doc_lines WHERE {m(r.cross_check)})"
        elif r.cross_check:
            rows = f"SELECT DISTINCT path FROM doc_lines WHERE {m(r.pattern)} AND path NOT IN (SELECT path FROM doc_lines WHERE {m(r.cross_check)})"
        else:
            rows = f"SELECT path FROM ({presence_sql('doc_lines', [r])})"
        parts.append(f"SELECT {q.lit(r.rule_id)} AS rule_id, {q.lit(r.severity)} AS severity, count(*) AS violations, count(DISTINCT path) AS places FROM ({rows}) HAVING count(*) > 0")
    return "\nUNION ALL\n".join(parts)


def _rule_counts(spark, d, n):
    hits = rulescan.scan_rules(corpus.document_files(spark, d), rule_range(n))
    return hits.groupBy("rule_id", "severity").agg(F.count("*").alias("violations"), F.countDistinct(F.when(F.col("path").startswith("[NOT FOUND"), F.col("project")).otherwise(F.col("path"))).alias("places"))


@query("rule_table_scan", "DET1 DET2 DET3 DET5 DET6 DET9 DET10", q.with_docs(rule_scan_sql(rule_range(660))))
def rule_table_scan(spark, d):
    return _rule_counts(spark, d, 660)


@query("rule_table_scan_138", "DET1 DET2 DET3 DET5 DET6 DET9 DET10", q.with_docs(rule_scan_sql(rule_range(138))))
def rule_table_scan_138(spark, d):
    return _rule_counts(spark, d, 138)


# --- extension surface ---------------------------------------------------------------------


def _long_lines(files, rules):
    """A user's detector: lines longer than the number the rule's pattern names."""
    source = corpus.with_lines(files)
    parts = []
    for r in rules:
        hits = F.filter(
            F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda h: F.length(h["line"]) > int(r.pattern)
        )
        rows = source.select("project", "path", F.inline(hits))
        parts.append(
            rows.select(
                "project", *[F.lit(v).alias(n) for n, v in (("rule_id", r.rule_id), ("severity", r.severity), ("category", r.category), ("description", r.description))],
                "path", "line_no", F.substring("line", 1, 120).alias("match_text"),
            )
        )
    return metrics.union_all(parts)


PLUGIN_RULES = [CODE_RULES[4], CROSS, Rule("long-line", "60", "SUGGEST", "style", type="long-line")]


@query(
    "plugin_scan", "UDF1 UDF2",
    f"""WITH {q.CODE_LINES_CTE}, kept AS (SELECT * FROM code_lines WHERE NOT contains(path, '/vendor/')), p AS ({presence_sql('kept', [CODE_RULES[4]])}), c0 AS ({presence_sql('kept', [CROSS])}),
c AS (SELECT project, rule_id, path, min(line_no) AS line_no FROM c0 WHERE path IN (SELECT path FROM code WHERE NOT regexp_matches(content, '\\.catch\\(')) GROUP BY ALL)
SELECT rule_id, project, count(*) AS hits, CAST(sum(line_no) AS BIGINT) AS line_sum FROM (SELECT rule_id, project, line_no FROM p UNION ALL SELECT rule_id, project, line_no FROM c UNION ALL SELECT 'long-line', project, line_no FROM kept WHERE length(line) > 60) GROUP BY ALL""",
)
def plugin_scan(spark, d):
    from dataclasses import replace

    from siftmill.operators import extend

    detectors = extend.standard_detectors().register("long-line", _long_lines)
    rules = [replace(r, type="cross-check") if r is CROSS else r for r in PLUGIN_RULES]
    hits = extend.PlugIn(detectors, rules).scan(corpus.code_files(spark, d))
    return hits.groupBy("rule_id", "project").agg(F.count("*").alias("hits"), F.sum(F.col("line_no").cast("long")).alias("line_sum"))
