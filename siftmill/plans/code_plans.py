"""Queries of the code detectors over the derived source-code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions import text as X
from siftmill.operators import code, conventions, graph, metrics, mining
from siftmill.plans import sqltext as q
from siftmill.plans.registry import query
from siftmill.plans.scan_plans import CODE_RULES
from siftmill.sources import corpus

from siftmill.sources.tables import table

SUMMARY = "count(*) AS hits, count(DISTINCT path) AS files, CAST(sum(line_no) AS BIGINT) AS line_sum"


def _summary(hits, *keys):
    return hits.groupBy(*keys).agg(
        F.count("*").alias("hits"), F.countDistinct("path").alias("files"), F.sum(F.col("line_no").cast("long")).alias("line_sum")
    )


def _win(before: int, behind: int) -> str:
    first = f"{before} PRECEDING" if before >= 0 else f"{-before} FOLLOWING"
    return f"coalesce(string_agg(line, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {first} AND {behind} FOLLOWING), '')"


TRIMMED = "trim(line, chr(32) || chr(9) || chr(10) || chr(13))"


def _pattern_sql(patterns: dict, langs: str) -> str:
    parts = []
    for name, (p, without) in patterns.items():
        cond = f"regexp_matches(t, {q.lit(p)})" + (f" AND NOT regexp_matches(t, {q.lit(without)})" if without else "")
        parts.append(f"SELECT project, {q.lit(name)} AS pattern_id, path, line_no FROM l WHERE lang IN {langs} AND {cond}")
    return " UNION ALL ".join(parts)


def _detector_sql(patterns: dict, unchecked: tuple, name: str, langs: str) -> str:
    p, handler, k = unchecked
    return q.with_code_lines(
        f""", l AS (SELECT *, {TRIMMED} AS t, {_win(-1, k)} AS nxt FROM code_lines), h AS ({_pattern_sql(patterns, langs)}
 UNION ALL SELECT project, {q.lit(name)}, path, line_no FROM l WHERE lang IN {langs} AND regexp_matches(t, {q.lit(p)}) AND NOT regexp_matches(nxt, {q.lit(handler)}))
SELECT project, pattern_id, {SUMMARY} FROM h GROUP BY ALL"""
    ).replace("\n, l AS", ", l AS")


@query("server_detectors", "DET19", _detector_sql(code.SERVER_PATTERNS, code.UNCHECKED_CALL, "missing_error_handling", "('php')"))
def server_detectors(spark, d):
    return _summary(code.detect(corpus.code_files(spark, d), code.SERVER_DETECTORS), "project", "pattern_id")


@query("client_detectors", "DET20", _detector_sql(code.CLIENT_PATTERNS, code.UNCHECKED_FETCH, "missing_fetch_error", "('javascript', 'typescript')"))
def client_detectors(spark, d):
    return _summary(code.detect(corpus.code_files(spark, d), code.CLIENT_DETECTORS), "project", "pattern_id")


CATALOG = [
    {"id": "try-swallow", "languages": ["python"], "detect": r"^try:", "detect_context_lines": 2, "detect_context_match": r"except.*pass"},
    {"id": "print-call", "languages": ["python"], "detect": r"\bPRINT\(", "case_insensitive": True, "detect_exclude": r"print\(y\)"},
    {"id": "db-call", "languages": ["php"], "detect": r"\$wpdb->", "detect_context_lines": 3, "detect_context_match": r"echo"},
    {"id": "todo-comment", "languages": ["php", "javascript"], "detect": r"TODO|HACK|FIXME"},
]


def _catalog_sql() -> str:
    parts = []
    for e in CATALOG:
        cond = f"lang IN {q.sql_in(e['languages'])} AND NOT regexp_matches(t, {q.lit(chr(94) + '(#|' + chr(34) * 3 + '|' + chr(39) * 3 + ')')})"
        cond += f" AND regexp_matches(t, {q.lit(('(?i)' if e.get('case_insensitive') else '') + e['detect'])})"
        if e.get("detect_exclude"):
            cond += f" AND NOT regexp_matches(t, {q.lit(e['detect_exclude'])})"
        if e.get("detect_context_match"):
            cond += f" AND regexp_matches(c{e['detect_context_lines']}, {q.lit(e['detect_context_match'])})"
        parts.append(f"SELECT {q.lit(e['id'])} AS pattern_id, path, line_no, t AS line FROM l WHERE {cond}")
    return f"l AS (SELECT *, {TRIMMED} AS t, {_win(0, 2)} AS c2, {_win(0, 3)} AS c3 FROM code_lines), h AS ({' UNION ALL '.join(parts)})"


def _catalog_hits(spark, d):
    return code.detect(corpus.code_files(spark, d), [code.catalog_detector(e) for e in CATALOG])


@query("catalog_detections", "DET18", f"WITH {q.CODE_LINES_CTE}, {_catalog_sql()} SELECT pattern_id, path, line_no, line FROM h")
def catalog_detections(spark, d):
    return _catalog_hits(spark, d).select("pattern_id", "path", "line_no", "line")


@query(
    "pattern_clusters", "AGG66",
    f"""WITH {q.CODE_LINES_CTE}, {_catalog_sql()}, n AS (SELECT pattern_id, count(*) AS "count", count(DISTINCT path) AS files FROM h GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY path, line_no) AS INT) AS rn FROM h)
SELECT pattern_id, "count", files, rn, path, line_no, line FROM r JOIN n USING (pattern_id) WHERE rn <= 3""",
)
def pattern_clusters(spark, d):
    return metrics.clusters_by_pattern(_catalog_hits(spark, d))


# --- conventions ---------------------------------------------------------------------------

CASE_SQL = """CASE WHEN contains(name, '_') AND name = lower(name) THEN 'snake_case' WHEN contains(name, '_') AND name = upper(name) THEN 'UPPER_SNAKE' WHEN contains(name, '-') THEN 'kebab-case'
 WHEN regexp_matches(name, '^[A-Z]') AND NOT contains(name, '_') THEN 'PascalCase' WHEN regexp_matches(name, '^[a-z]') AND NOT contains(name, '_') AND regexp_matches(name, '[A-Z]') THEN 'camelCase'
 WHEN name = lower(name) THEN 'lowercase' ELSE 'mixed' END"""


def _names_sql(source: str, text: str, extra: str = "") -> str:
    parts = []
    for kind, patterns in (("function", code.FUNCTION_NAMES), ("class", code.CLASS_NAMES)):
        for lang in ("php", "javascript", "python"):
            for p in patterns[lang]:
                parts.append(f"SELECT project, path, lang, {extra}{q.lit(kind)} AS kind, unnest(regexp_extract_all({text}, {q.lit(p)}, 1)) AS name FROM {source} WHERE lang = {q.lit(lang)}")
    return f"nm0 AS ({' UNION ALL '.join(parts)}), nm AS (SELECT *, {CASE_SQL} AS case_class FROM nm0 WHERE length(name) > 2 AND (kind = 'class' OR NOT starts_with(name, '__')))"


CONV = """cc AS (SELECT lang, kind, case_class, count(*) AS n FROM nm GROUP BY ALL), cv AS (SELECT lang, kind, CAST(sum(n) AS BIGINT) AS total, arg_max(case_class, {'n': n, 'c': case_class}) AS case_class, max(n) AS "count", max(n)::DOUBLE / sum(n) AS confidence FROM cc GROUP BY ALL),
conv AS (SELECT * FROM cv WHERE total >= CASE kind WHEN 'function' THEN 10 ELSE 5 END AND confidence >= 0.4)"""


@query("declared_names", "FUN1", f"WITH {q.CODE_CTE}, {_names_sql('code', 'content')} SELECT lang, kind, case_class, count(*) AS names, count(DISTINCT name) AS distinct_names FROM nm GROUP BY ALL")
def declared_names(spark, d):
    return code.declared_names(corpus.code_files(spark, d)).groupBy("lang", "kind", "case_class").agg(F.count("*").alias("names"), F.countDistinct("name").alias("distinct_names"))


@query("naming_conventions", "AGG61", f"WITH {q.CODE_CTE}, {_names_sql('code', 'content')}, {CONV} SELECT * FROM conv")
def naming_conventions(spark, d):
    return conventions.naming_conventions(corpus.code_files(spark, d), share=0.4)


@query(
    "naming_violations", "DET21",
    f"""WITH {q.CODE_LINES_CTE}, {_names_sql('code_lines', 'line', 'line_no, ')}, {CONV} SELECT nm.project, nm.lang, nm.kind, nm.case_class, conv.case_class AS expected, {SUMMARY}
FROM nm JOIN conv ON nm.lang = conv.lang AND nm.kind = conv.kind AND nm.case_class <> conv.case_class GROUP BY ALL""",
)
def naming_violations(spark, d):
    files = corpus.code_files(spark, d)
    learned = conventions.naming_conventions(files, share=0.4)
    return _summary(conventions.naming_violations(files, learned), "project", "lang", "kind", "case_class", "expected")


INDENT = """f AS (SELECT path, line_no, CASE WHEN starts_with(line, chr(9)) THEN 'tab' ELSE CAST(length(regexp_extract(line, '^( *)', 1)) AS VARCHAR) END AS indent FROM code_lines WHERE regexp_matches(line, '^[ \\t]')),
g AS (SELECT path, arg_min(indent, line_no) AS indent FROM f WHERE indent IN ('tab', '2', '4', '8') GROUP BY path), ic AS (SELECT indent, count(*) AS n FROM g GROUP BY 1)"""


@query("indent_styles", "AGG60", f"WITH {q.CODE_LINES_CTE}, {INDENT} SELECT indent, n FROM ic")
def indent_styles(spark, d):
    return conventions.indent_styles(corpus.code_files(spark, d))


@query(
    "indent_convention", "AGG60",
    f"""WITH {q.CODE_LINES_CTE}, {INDENT}, t AS (SELECT sum(n) AS total, coalesce(sum(n) FILTER (WHERE indent = 'tab'), 0) AS tabs, arg_max(indent, n) FILTER (WHERE indent <> 'tab') AS w, max(n) FILTER (WHERE indent <> 'tab') AS m FROM ic)
SELECT CASE WHEN tabs::DOUBLE / total > 0.7 THEN 'tab' ELSE w END AS indent, CASE WHEN tabs::DOUBLE / total > 0.7 THEN tabs::DOUBLE / total ELSE m::DOUBLE / total END AS confidence FROM t WHERE tabs::DOUBLE / total > 0.7 OR m::DOUBLE / total > 0.5""",
)
def indent_convention(spark, d):
    return conventions.indent_convention(corpus.code_files(spark, d))


IMPORTS = f"""l AS (SELECT *, {TRIMMED} AS t, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM code_lines WHERE lang IN ('python', 'javascript')),
m AS (SELECT lang, path, prev, CASE lang WHEN 'python' THEN regexp_extract(t, '^(?:from\\s+(\\S+)\\s+import|import\\s+(\\S+))', 1) || regexp_extract(t, '^(?:from\\s+(\\S+)\\s+import|import\\s+(\\S+))', 2) ELSE regexp_extract(t, '^import\\s+.*?from\\s+[''"]([^''"]+)[''"]', 1) END AS module FROM l),
pf AS (SELECT lang, path, count(*) AS n, count(*) FILTER (WHERE starts_with(module, '.')) AS rel, bool_or(trim(coalesce(prev, 'x')) = '') AS grouped FROM m WHERE module <> '' GROUP BY ALL),
st AS (SELECT lang, CAST(sum(rel) AS BIGINT) AS relative, CAST(sum(n) AS BIGINT) AS imports, count(*) FILTER (WHERE n >= 3 AND grouped) AS grouped, count(*) FILTER (WHERE n >= 3) AS files FROM pf GROUP BY lang)"""


@query("import_styles", "AGG62", f"WITH {q.CODE_LINES_CTE}, {IMPORTS} SELECT * FROM st")
def import_styles(spark, d):
    return conventions.import_styles(corpus.code_files(spark, d))


@query(
    "import_conventions", "AGG62",
    f"""WITH {q.CODE_LINES_CTE}, {IMPORTS}, x AS (SELECT lang, imports, files, CASE WHEN imports > 0 THEN relative::DOUBLE / imports ELSE 0 END AS r, CASE WHEN files > 0 THEN grouped::DOUBLE / files ELSE 0 END AS g FROM st)
SELECT lang, 'grouped_imports' AS pattern, g AS confidence FROM x WHERE files >= 10 AND g > 0.6 UNION ALL SELECT lang, 'flat_imports', 1 - g FROM x WHERE files >= 10 AND 1 - g > 0.6
UNION ALL SELECT lang, 'relative_imports', r FROM x WHERE imports >= 10 AND r > 0.6 UNION ALL SELECT lang, 'absolute_imports', 1 - r FROM x WHERE imports >= 10 AND 1 - r > 0.6""",
)
def import_conventions(spark, d):
    return conventions.import_conventions(conventions.import_styles(corpus.code_files(spark, d)))


@query(
    "file_naming", "AGG63",
    f"""WITH {q.CODE_CTE}, s AS (SELECT regexp_extract(path, '([^/]+?)(\\.[^./]+)?$', 1) AS name FROM code), c AS (SELECT {CASE_SQL} AS case_class, count(*) AS n FROM s WHERE length(name) >= 3 GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, arg_max(case_class, n) AS case_class, max(n) AS "count", max(n)::DOUBLE / sum(n) AS confidence FROM c HAVING sum(n) >= 20 AND max(n)::DOUBLE / sum(n) >= 0.5""",
)
def file_naming(spark, d):
    return conventions.file_naming(corpus.code_files(spark, d))


@query(
    "test_layout", "AGG64",
    f"""WITH {q.CODE_CTE}, t AS (SELECT project, regexp_matches(regexp_replace(path, '/[^/]*$', ''), 'test') AS apart FROM (SELECT project, replace(path, 'my-page', CASE WHEN length(content) % 2 = 0 THEN 'my-spec' ELSE 'page' END) AS path FROM code) WHERE regexp_matches(lower(regexp_extract(path, '([^/]+)$', 1)), 'test|spec')),
c AS (SELECT project, count(*) AS tests, count(*) FILTER (WHERE apart) AS separate FROM t GROUP BY 1)
SELECT *, separate::DOUBLE / tests AS share_separate, CASE WHEN separate::DOUBLE / tests > 0.7 THEN 'separate_tests' WHEN 1 - separate::DOUBLE / tests > 0.7 THEN 'colocated_tests' END AS layout FROM c""",
)
def test_layout(spark, d):
    # Every second page file is a spec.
    spec = F.when(F.length("content") % 2 == 0, "my-spec").otherwise("page")
    files = corpus.code_files(spark, d).withColumn("path", F.replace(F.col("path"), F.lit("my-page"), spec))
    return conventions.test_layout(files)


# --- handlers, blocks, sizes ---------------------------------------------------------------


def _lang_lines_sql(patterns: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT project, path, lang, line_no FROM code_lines WHERE lang = {q.lit(lang)} AND regexp_matches(line, {q.lit(p)})" for lang, p in patterns.items() if lang in ("php", "javascript", "python")
    )


@query("empty_handlers", "DET22", f"WITH {q.CODE_LINES_CTE}, h AS ({_lang_lines_sql(code.EMPTY_HANDLERS)}) SELECT project, path, lang, line_no FROM h")
def empty_handlers(spark, d):
    return code.empty_handlers(corpus.code_files(spark, d))


RUNS = """r AS (SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island FROM code_lines WHERE regexp_matches(line, '^\\s*(//|#)'))
SELECT project, path, lang, min(line_no) AS line_no, CAST(count(*) AS INT) AS length FROM r GROUP BY project, path, lang, island HAVING count(*) >= 2"""


@query("commented_blocks", "DET23", f"WITH {q.CODE_LINES_CTE}, {RUNS}")
def commented_blocks(spark, d):
    return code.commented_blocks(corpus.code_files(spark, d), min_length=2)


@query("long_files", "DET24", f"WITH {q.CODE_CTE} SELECT project, path, lang, CAST(length(content) - length(replace(content, chr(10), '')) AS INT) AS lines FROM code WHERE length(content) - length(replace(content, chr(10), '')) > 100")
def long_files(spark, d):
    return code.long_files(corpus.code_files(spark, d), max_lines=100)


# --- flow ----------------------------------------------------------------------------------

TAINT = f"""src AS (SELECT path, line_no, regexp_extract(line, '\\$([A-Za-z0-9_]+)\\s*=\\s*\\$_(?:GET|POST|REQUEST|SERVER)', 1) AS var FROM code_lines WHERE regexp_matches(line, '\\$([A-Za-z0-9_]+)\\s*=\\s*\\$_(?:GET|POST|REQUEST|SERVER)')),
sinks(sink, risk) AS (VALUES {', '.join('(' + q.lit(s) + ', ' + q.lit(r) + ')' for s, r in code.SINKS.items())}),
sk AS (SELECT project, path, line_no AS sink_line, line, sink, risk FROM code_lines JOIN sinks ON contains(line, sink)),
fl AS (SELECT sk.project, sk.path, var, max(src.line_no) AS source_line, sink_line, sink, risk FROM sk JOIN src ON src.path = sk.path AND src.line_no <= sink_line AND contains(line, '$' || var) GROUP BY ALL),
cl AS (SELECT path, line_no, line FROM code_lines WHERE regexp_matches(line, {q.lit('|'.join(code.SANITIZERS))})),
taint AS (SELECT * FROM fl WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.path = fl.path AND cl.line_no BETWEEN source_line AND sink_line AND contains(cl.line, '$' || var)))"""


@query("taint_flows", "DET25", f"WITH {q.CODE_LINES_CTE}, {TAINT} SELECT project, path, var, source_line, sink_line, sink, risk FROM taint")
def taint_flows(spark, d):
    return code.taint_flows(corpus.code_files(spark, d))


@query(
    "direct_flows", "DET25",
    f"""WITH {q.CODE_LINES_CTE}, sinks(sink, risk) AS (VALUES {', '.join('(' + q.lit(s) + ', ' + q.lit(r) + ')' for s, r in code.SINKS.items())}),
inlined AS (SELECT project, path, line_no, replace(line, '$name;', '$_GET[''name''];') AS line FROM code_lines),
d AS (SELECT project, path, line_no, line, unnest(list_distinct(regexp_extract_all(line, {q.lit(code.DIRECT_INPUT)}))) AS input FROM inlined WHERE NOT regexp_matches(line, {q.lit('|'.join(code.SANITIZERS))}))
SELECT project, path, line_no, input, sink, risk FROM d JOIN sinks ON contains(line, sink)""",
)
def direct_flows(spark, d):
    # The corpus assigns input to a variable first; here the variable is written out.
    files = corpus.code_files(spark, d).withColumn("content", F.replace("content", F.lit("$name;"), F.lit("$_GET['name'];")))
    return code.direct_flows(files)


RACES = f"""w AS (SELECT *, {_win(4, 5)} AS c5, {_win(4, 15)} AS c15, {_win(-1, 10)} AS n10 FROM code_lines),
races AS (SELECT project, path, line_no, 'race_stock' AS pattern_id FROM w WHERE regexp_matches(line, '(stock|quantity|inventory)\\s*-=\\s*[0-9]+') AND NOT regexp_matches(c5, {q.lit(code.LOCKS)})
 UNION ALL SELECT project, path, line_no, 'race_usage' FROM w WHERE regexp_matches(line, 'usage_count\\s*\\+=\\s*1') AND NOT regexp_matches(c5, {q.lit(code.LOCKS)})
 UNION ALL SELECT project, path, line_no, 'race_option' FROM w WHERE regexp_matches(line, '\\$[A-Za-z0-9_]+\\s*=\\s*get_option\\([^)]+\\)') AND regexp_matches(n10, 'update_option\\([^)]+,\\s*\\$[A-Za-z0-9_]+') AND NOT regexp_matches(c15, {q.lit(code.LOCKS)}))"""


@query("race_conditions", "DET26", f"WITH {q.CODE_LINES_CTE}, {RACES} SELECT project, path, line_no, pattern_id FROM races")
def race_conditions(spark, d):
    return code.detect(corpus.code_files(spark, d), code.RACE_DETECTORS).select("project", "path", "line_no", "pattern_id")


ASYNCS = f"""aw AS (SELECT *, {_win(0, 5)} AS a5, {_win(0, 10)} AS a10 FROM code_lines), st AS (SELECT project, path, line_no FROM code_lines WHERE regexp_matches(line, {q.lit(code.ASYNC_START)})),
en AS (SELECT path, line_no FROM code_lines WHERE regexp_matches(line, '^\\s*\\}}')), bo AS (SELECT st.project, st.path, st.line_no, min(en.line_no) AS e FROM st JOIN en ON en.path = st.path AND en.line_no >= st.line_no GROUP BY ALL),
bt AS (SELECT bo.project, bo.path, bo.line_no, string_agg(l.line, chr(10)) AS body FROM bo JOIN code_lines l ON l.path = bo.path AND l.line_no BETWEEN bo.line_no AND bo.e
 WHERE NOT EXISTS (SELECT 1 FROM st x WHERE x.path = bo.path AND x.line_no > bo.line_no AND x.line_no <= bo.e) GROUP BY ALL),
asyncs AS (SELECT project, path, line_no, 'then_without_catch' AS pattern_id FROM aw WHERE regexp_matches(line, '\\.then\\(') AND NOT contains(a5, '.catch(')
 UNION ALL SELECT project, path, line_no, 'fetch_without_handler' FROM aw WHERE regexp_matches(line, 'fetch\\(') AND NOT regexp_matches(a10, '(\\.catch\\(|try\\s*\\{{)')
 UNION ALL SELECT project, path, line_no, 'await_without_try' FROM bt WHERE contains(body, 'await') AND NOT contains(body, 'try'))"""


@query("async_errors", "DET27", f"WITH {q.CODE_LINES_CTE}, {ASYNCS} SELECT project, path, line_no, pattern_id FROM asyncs")
def async_errors(spark, d):
    return code.detect(corpus.code_files(spark, d), code.ASYNC_DETECTORS).select("project", "path", "line_no", "pattern_id")


@query(
    "flow_risk", "DET28",
    f"""WITH {q.CODE_LINES_CTE}, {TAINT}, {RACES}, {ASYNCS}, u AS (SELECT path, CASE WHEN risk IN ('SQL Injection', 'Command Injection', 'Code Injection') THEN 1 ELSE 0 END AS c, 1 AS f, 0 AS h FROM taint
 UNION ALL SELECT path, CASE WHEN pattern_id = 'race_stock' THEN 1 ELSE 0 END, 0, CASE WHEN pattern_id = 'race_usage' THEN 1 ELSE 0 END FROM races UNION ALL SELECT path, 0, 0, 1 FROM asyncs),
s AS (SELECT path, CAST(sum(c) AS BIGINT) AS critical, CAST(sum(f) - sum(c) + sum(h) AS BIGINT) AS high FROM u GROUP BY path)
SELECT path, critical, high, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 5 THEN 'HIGH' WHEN high > 0 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk FROM s""",
)
def flow_risk(spark, d):
    files = corpus.code_files(spark, d)
    return code.flow_risk(code.taint_flows(files), code.detect(files, code.RACE_DETECTORS), code.detect(files, code.ASYNC_DETECTORS))


# --- text forms of the tree checks ---------------------------------------------------------


@query("missing_login_check", "DET29", f"WITH {q.CODE_CTE} SELECT project, path FROM code WHERE contains(path, 'account') AND NOT contains(path, 'login.php') AND NOT contains(path, 'register.php') AND NOT regexp_matches(content, 'is_user_logged_in\\s*\\(')")
def missing_login_check(spark, d):
    return code.missing_login_check(corpus.code_files(spark, d)).select("project", "path")


@query(
    "tree_checks", "DET30 DET32",
    f"""WITH {q.CODE_LINES_CTE}, w AS (SELECT *, {TRIMMED} AS t, {_win(0, 3)} AS a3 FROM code_lines)
SELECT project, path, line_no, 'unescaped_output' AS pattern_id FROM w WHERE lang = 'php' AND regexp_matches(t, '\\becho\\b.*\\$') AND NOT regexp_matches(t, {q.lit(code.ESCAPES)}) AND NOT regexp_matches(t, 'the_|get_header|get_footer')
UNION ALL SELECT project, path, line_no, 'fetch_without_nonce' FROM w WHERE lang = 'javascript' AND regexp_matches(t, '\\bfetch\\s*\\(') AND regexp_matches(t, '(?i)cart|checkout') AND NOT regexp_matches(a3, 'X-WP-Nonce|\\.nonce|_nonce')""",
)
def tree_checks(spark, d):
    return code.detect(corpus.code_files(spark, d), code.TREE_DETECTORS).select("project", "path", "line_no", "pattern_id")


@query(
    "calls_in_loops", "DET31",
    f"""WITH {q.CODE_LINES_CTE}, ok AS (SELECT path FROM code WHERE NOT regexp_matches(content, 'update_meta_cache\\s*\\(|have_posts\\s*\\(|the_post\\s*\\(')),
b AS (SELECT *, sum(length(regexp_replace(line, '[^{{]', '', 'g')) - length(regexp_replace(line, '[^}}]', '', 'g'))) OVER (PARTITION BY path ORDER BY line_no) AS cum FROM code_lines WHERE path IN (SELECT path FROM ok)),
lp AS (SELECT path, line_no AS loop_line, cum - (length(regexp_replace(line, '[^{{]', '', 'g')) - length(regexp_replace(line, '[^}}]', '', 'g'))) AS base FROM b WHERE regexp_matches(line, '\\b(foreach|for|while)\\b.*\\{{')),
ca AS (SELECT project, path, line_no FROM b WHERE regexp_matches(line, 'get_post_meta\\s*\\(')),
inn AS (SELECT ca.project, ca.path, ca.line_no, lp.loop_line FROM ca JOIN lp ON ca.path = lp.path AND lp.loop_line < ca.line_no WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.path = ca.path AND b.line_no >= lp.loop_line AND b.line_no < ca.line_no AND b.cum <= lp.base)),
o AS (SELECT project, path, line_no, min(loop_line) AS loop_line FROM inn GROUP BY ALL) SELECT project, path, loop_line, min(line_no) AS line_no FROM o GROUP BY ALL""",
)
def calls_in_loops(spark, d):
    return code.calls_in_loops(corpus.code_files(spark, d))


# --- inventory and coverage ----------------------------------------------------------------


def _inventory_sql() -> str:
    def one(lang, kind, name, sev, cond):
        return f"SELECT project, path, lang, line_no, {q.lit(kind)} AS pattern_type, {q.lit(name)} AS pattern_name, {q.lit(sev)} AS severity, t AS context FROM iw WHERE lang = {q.lit(lang)} AND {cond}"

    def names(lang, kind, p):
        return f"SELECT project, path, lang, line_no, {q.lit(kind)}, unnest(regexp_extract_all(t, {q.lit(p)}, 1)), 'SUGGEST', t FROM iw WHERE lang = {q.lit(lang)}"

    parts = []
    for fn in code.SECURITY_FUNCTIONS:
        cond = f"regexp_matches(t, {q.lit(chr(92) + 'b' + fn + chr(92) + 's*' + chr(92) + '(')})"
        if fn.startswith("wp_remote_"):
            cond += f" AND NOT regexp_matches(near, {q.lit(code.NEARBY_HANDLING)})"
        if fn == "wp_verify_nonce":
            cond += " AND NOT regexp_matches(t, 'if\\s*\\(.*wp_verify_nonce')"
        parts.append(one("php", "security_op", fn, "CRITICAL", cond))
    parts += [one("php", "db_op", fn, "HIGH", f"contains(t, {q.lit(fn)})") for fn in code.DB_FUNCTIONS]
    parts += [one("php", "hook", fn, "SUGGEST", f"regexp_matches(t, {q.lit(chr(92) + 'b' + fn + chr(92) + 's*' + chr(92) + '(')})") for fn in code.HOOK_FUNCTIONS]
    for lang, words in (("php", code.ERROR_WORDS), ("javascript", code.CLIENT_ERROR_WORDS)):
        parts += [one(lang, "error_handling", w, "HIGH", f"regexp_matches(t, {q.lit(chr(92) + 'b' + w + chr(92) + 'b')})") for w in words]
    parts += [one("javascript", "function_call", n, "CRITICAL", f"regexp_matches(t, {q.lit(p)})") for n, p in code.CLIENT_CALLS.items()]
    parts.append(names("php", "function_def", r"function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("))
    parts.append(names("php", "class_def", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)"))
    parts.append(names("javascript", "function_def", r"(?:function|const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*[=\(]"))
    parts.append(names("javascript", "class_def", r"class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)"))
    parts.append(names("javascript", "hook", r"\b(use[A-Z][a-zA-Z]*)\s*\("))
    return f"iw AS MATERIALIZED (SELECT *, {TRIMMED} AS t, {_win(5, 5)} AS near FROM code_lines WHERE lang IN ('php', 'javascript')), inv AS MATERIALIZED ({' UNION ALL '.join(parts)})"


INV = _inventory_sql()


@query("code_inventory", "DET33 DET34", f"WITH {q.CODE_LINES_CTE}, {INV} SELECT project, lang, pattern_type, pattern_name, severity, {SUMMARY} FROM inv GROUP BY ALL")
def code_inventory(spark, d):
    return _summary(code.inventory(corpus.code_files(spark, d)), "project", "lang", "pattern_type", "pattern_name", "severity")


COVER_RULES = {r.rule_id: r.pattern for r in CODE_RULES} | {"hook-call": "add_action init load_item_1", "class-def": "class ItemService1", "remote": "body wp_remote_get"}
_tok = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'))"


def _coverage_sql() -> str:
    rules = ", ".join(f"({i}, {q.lit(k)}, {q.lit(p)})" for i, (k, p) in enumerate(COVER_RULES.items()))
    return f"""rl(i, rid, pat) AS (VALUES {rules}), ctx AS (SELECT DISTINCT context FROM inv), rx AS (SELECT context, min(i) AS i FROM ctx JOIN rl ON regexp_matches(context, pat) GROUP BY context),
tk AS (SELECT context, {_tok('context')} AS a FROM ctx), rt AS (SELECT i, rid, {_tok('pat')} AS b FROM rl),
jc AS (SELECT context, i, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END AS s FROM tk, rt),
bj AS (SELECT context, max(s) AS s, arg_min(i, {{'s': -s, 'i': i}}) AS i FROM jc GROUP BY context),
cov AS MATERIALIZED (SELECT inv.*, CASE WHEN rx.i IS NOT NULL THEN 'regex' WHEN bj.s >= 0.5 THEN 'token' ELSE 'none' END AS method, CASE WHEN rx.i IS NOT NULL THEN 1.0 ELSE bj.s END AS similarity,
 CASE WHEN rx.i IS NOT NULL THEN (SELECT rid FROM rl WHERE rl.i = rx.i) WHEN bj.s >= 0.5 THEN (SELECT rid FROM rl WHERE rl.i = bj.i) END AS rule_id FROM inv LEFT JOIN rx USING (context) JOIN bj USING (context))"""


COV = f"{q.CODE_LINES_CTE}, {INV}, {_coverage_sql()}"


def _covered(spark, d):
    return mining.rule_coverage(code.inventory(corpus.code_files(spark, d)), COVER_RULES)


@query("coverage_matches", "JOI13", f"WITH {COV} SELECT pattern_type, pattern_name, method, rule_id, similarity, {SUMMARY} FROM cov GROUP BY pattern_type, pattern_name, method, rule_id, similarity")
def coverage_matches(spark, d):
    return _summary(_covered(spark, d), "pattern_type", "pattern_name", "method", "rule_id", "similarity")


def _cnt(sev):
    return f"count(*) FILTER (WHERE severity = '{sev}') AS {sev.lower()}_total, count(*) FILTER (WHERE severity = '{sev}' AND method <> 'none') AS {sev.lower()}_covered"


FCOV = f"""fc AS (SELECT project, path, count(*) AS total, count(*) FILTER (WHERE method <> 'none') AS covered, {_cnt('CRITICAL')}, {_cnt('HIGH')}, {_cnt('SUGGEST')} FROM cov GROUP BY ALL),
fcov AS (SELECT *, covered::DOUBLE / total * 100 AS percent, ((CASE WHEN critical_total > 0 THEN critical_covered::DOUBLE / critical_total * 0.5::DOUBLE ELSE 0 END) + (CASE WHEN high_total > 0 THEN high_covered::DOUBLE / high_total * 0.3::DOUBLE ELSE 0 END)
 + (CASE WHEN suggest_total > 0 THEN suggest_covered::DOUBLE / suggest_total * 0.2::DOUBLE ELSE 0 END)) * 100 AS weighted FROM fc)"""


@query("file_coverage", "AGG21", f"WITH {COV}, {FCOV} SELECT * FROM fcov")
def file_coverage(spark, d):
    return mining.file_coverage(_covered(spark, d))


@query("coverage_by_type", "AGG21", f"WITH {COV} SELECT project, pattern_type, count(*) AS total, count(*) FILTER (WHERE method <> 'none') AS covered FROM cov GROUP BY ALL")
def coverage_by_type(spark, d):
    return _covered(spark, d).groupBy("project", "pattern_type").agg(F.count("*").alias("total"), F.count_if(F.col("method") != "none").alias("covered"))


@query(
    "project_coverage", "AGG22",
    f"""WITH {COV}, {FCOV} SELECT project, count(*) AS files, CAST(sum(total) AS BIGINT) AS total, CAST(sum(covered) AS BIGINT) AS covered, count(*) FILTER (WHERE percent >= 100) AS files_full, count(*) FILTER (WHERE percent >= 80 AND percent < 100) AS files_80,
 count(*) FILTER (WHERE percent < 80) AS files_below, sum(covered)::DOUBLE / sum(total) * 100 AS percent FROM fcov GROUP BY project""",
)
def project_coverage(spark, d):
    return mining.project_coverage(mining.file_coverage(_covered(spark, d)))


def _gap_sql() -> str:
    api = " OR ".join(f"contains(lower(pattern_name), {q.lit(a.lower())})" for a in mining.GAP_APIS)
    sec = " OR ".join(f"starts_with(pattern_name, {q.lit(s)})" for s in mining.GAP_SECURITY)
    db = " OR ".join(f"contains(pattern_name, {q.lit(s)})" for s in mining.GAP_DB)
    return f"""g AS (SELECT *, CASE WHEN {api} THEN 'uncovered_api' WHEN {sec} THEN 'uncovered_security' WHEN pattern_type = 'error_handling' THEN 'uncovered_error' WHEN {db} THEN 'uncovered_db' ELSE 'context_specific' END AS gap_type FROM cov WHERE method = 'none')"""


@query(
    "coverage_gaps", "JOI14",
    f"""WITH {COV}, {_gap_sql()} SELECT gap_type, pattern_name, CASE gap_type WHEN 'uncovered_api' THEN 'CRITICAL' WHEN 'uncovered_security' THEN 'CRITICAL' WHEN 'uncovered_db' THEN 'HIGH' WHEN 'uncovered_error' THEN 'HIGH' ELSE severity END AS gap_severity,
 least(10, 5 + CASE WHEN gap_type IN ('uncovered_api', 'uncovered_security') THEN 3 ELSE 0 END + CASE WHEN similarity < 0.2 THEN 2 WHEN similarity < 0.4 THEN 1 ELSE 0 END + CASE WHEN pattern_type IN ('security_op', 'function_call') THEN 1 ELSE 0 END)::DOUBLE / 10 AS confidence, {SUMMARY} FROM g GROUP BY ALL""",
)
def coverage_gaps(spark, d):
    return _summary(mining.coverage_gaps(_covered(spark, d)), "gap_type", "pattern_name", "gap_severity", "confidence")


# --- mining over files ---------------------------------------------------------------------


@query(
    "unresolved_tags", "DET35",
    f"""WITH {q.CODE_CTE}, t AS (SELECT path, upper(unnest(regexp_extract_all(content, '(?i)(?://|#|/\\*)\\s*(TODO|FIXME|HACK|XXX)\\b', 1))) AS tag FROM code)
SELECT tag, count(*) AS occurrences, array_to_string(list_slice(list_sort(list_distinct(list(path))), 1, 5), ',') AS examples, least(count(*)::DOUBLE / 20, 0.8::DOUBLE) AS confidence FROM t WHERE tag <> 'TODO' GROUP BY tag HAVING count(*) >= 3""",
)
def unresolved_tags(spark, d):
    return code.unresolved_tags(corpus.code_files(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query(
    "magic_numbers", "DET36",
    f"""WITH {q.CODE_LINES_CTE}, n AS (SELECT path, unnest(regexp_extract_all(line, '(?:^|[^.A-Za-z0-9_])([0-9]{{2,}})\\b', 1)) AS number FROM code_lines WHERE NOT regexp_matches({TRIMMED}, '^(//|#|/\\*|\\*)'))
SELECT number, count(DISTINCT path) AS files FROM n WHERE length(number) >= 3 AND number NOT IN {q.sql_in(code.SAFE_NUMBERS)} GROUP BY number HAVING count(DISTINCT path) >= 3""",
)
def magic_numbers(spark, d):
    return code.magic_numbers(corpus.code_files(spark, d))


@query(
    "long_functions", "DET37",
    f"""WITH RECURSIVE {q.CODE_LINES_CTE}, b AS MATERIALIZED (SELECT project, path, lang, line_no, regexp_matches(line, {q.lit(code.FUNCTION_START)}) AS s, length(regexp_replace(line, '[^{{]', '', 'g')) - length(regexp_replace(line, '[^}}]', '', 'g')) AS d FROM code_lines),
g AS (SELECT *, count(*) FILTER (WHERE s) OVER (PARTITION BY path ORDER BY line_no) AS fn FROM b), c AS (SELECT *, sum(d) OVER (PARTITION BY path, fn ORDER BY line_no) AS depth, min(line_no) OVER (PARTITION BY path, fn) AS start FROM g WHERE fn > 0),
e AS (SELECT project, path, lang, start, min(line_no) AS stop FROM c WHERE depth <= 0 AND line_no > start GROUP BY ALL) SELECT project, path, lang, start AS line_no, CAST(stop - start AS INT) AS length FROM e WHERE stop - start > 8""",
)
def long_functions(spark, d):
    return code.long_functions(corpus.code_files(spark, d), min_lines=8)


def _lang_file_sql(patterns: dict, min_hits: int) -> str:
    cases = " ".join(f"WHEN {q.lit(lang)} THEN len(regexp_extract_all(content, {q.lit(p)}))" for lang, p in patterns.items() if lang in ("php", "javascript", "python"))
    return f"""WITH {q.CODE_CTE}, h AS (SELECT lang, path FROM code WHERE CASE lang {cases} END >= {min_hits})
SELECT lang, count(*) AS occurrences, array_to_string(list_slice(list_sort(list(path)), 1, 5), ',') AS examples FROM h GROUP BY lang"""


@query("debug_statements", "DET38", _lang_file_sql(code.DEBUG_CALLS, 3))
def debug_statements(spark, d):
    return code.language_files(corpus.code_files(spark, d), code.DEBUG_CALLS, 3).withColumn("examples", F.array_join("examples", ","))


@query("empty_handler_languages", "DET39", _lang_file_sql(code.EMPTY_HANDLERS, 1))
def empty_handler_languages(spark, d):
    return code.language_files(corpus.code_files(spark, d), code.EMPTY_HANDLERS, 1).withColumn("examples", F.array_join("examples", ","))


@query(
    "repeated_blocks", "DET40",
    f"""WITH {q.DOC_LINES_CTE}, w AS (SELECT path, line_no, {_win(0, 3).replace('line,', TRIMMED + ',')} AS block, lead(line_no, 3) OVER (PARTITION BY path ORDER BY line_no) AS more FROM doc_lines)
SELECT block, count(DISTINCT path) AS files, min(path) AS first_path FROM w WHERE more IS NOT NULL AND length(block) >= 40 AND NOT regexp_matches(block, '^(//|#|/\\*|\\*|import|from|use )') GROUP BY block HAVING count(DISTINCT path) >= 2""",
)
def repeated_blocks(spark, d):
    files = corpus.spread(corpus.document_files(spark, d))
    return code.repeated_blocks(files, min_files=2).select("block", "files", "first_path")


@query(
    "top_repeated_blocks", "DET40",
    f"""WITH {q.CODE_LINES_CTE}, w AS (SELECT path, line_no, {_win(0, 3).replace('line,', TRIMMED + ',')} AS block, lead(line_no, 3) OVER (PARTITION BY path ORDER BY line_no) AS more FROM code_lines)
SELECT block, count(DISTINCT path) AS files, least(count(DISTINCT path)::DOUBLE / 5, 0.9::DOUBLE) AS confidence FROM w WHERE more IS NOT NULL AND length(block) >= 40 AND NOT regexp_matches(block, '^(//|#|/\\*|\\*|import|from|use )') GROUP BY block HAVING count(DISTINCT path) >= 3 ORDER BY files DESC, block LIMIT 5""",
)
def top_repeated_blocks(spark, d):
    blocks = code.repeated_blocks(corpus.code_files(spark, d))
    return blocks.orderBy(F.desc("files"), "block").limit(5).select("block", "files", F.least(F.col("files") / 5, F.lit(0.9)).alias("confidence"))


@query(
    "api_facts", "DET42 FIL12 FIL13",
    f"""WITH {q.CODE_CTE}, s AS (SELECT project, path, regexp_replace(regexp_replace(content, '(?s)/\\*.*?\\*/', '', 'g'), '(?m)(^|[^:])//[^\\n]*|^\\s*#[^\\n]*', '\\1', 'g') AS c FROM code),
e AS (SELECT project, path, unnest(regexp_extract_all(c, '\\b(load_item_[A-Za-z0-9_]+)\\s*\\(', 1)) AS fact FROM s UNION ALL SELECT project, path, 'wp:' || unnest(regexp_extract_all(c, '\\b(wp_[a-z][a-z0-9_]*)\\s*\\(', 1)) FROM s
 UNION ALL SELECT project, path, 'wp:' || unnest(regexp_extract_all(c, '\\b(is_[a-z][a-z0-9_]*|has_[a-z][a-z0-9_]*)\\s*\\(', 1)) FROM s UNION ALL SELECT project, path, 'hook:' || unnest(regexp_extract_all(c, '(?:add_action|add_filter|do_action|apply_filters)\\s*\\(\\s*''([A-Za-z0-9_]+)''', 1)) FROM s
 UNION ALL SELECT project, path, '$input[''' || unnest(regexp_extract_all(c, '\\$_(?:GET|POST)\\[''([A-Za-z0-9_]+)''\\]', 1)) || ''']' FROM s UNION ALL SELECT project, path, 'const:' || unnest(regexp_extract_all(c, '\\b([A-Z][A-Z0-9]*_[A-Z0-9_]+)\\b', 1)) FROM s)
SELECT project, fact, count(DISTINCT path) AS files FROM e GROUP BY ALL""",
)
def api_facts(spark, d):
    rows = corpus.code_files(spark, d).select("project", F.explode(code.api_facts(F.col("content"))).alias("fact"))
    return rows.groupBy("project", "fact").agg(F.count("*").alias("files"))


@query(
    "signals_by_file", "JOI21",
    q.with_code(" UNION ALL ".join(f"SELECT {q.lit(r.rule_id)} AS rule_id, project, count(*) AS files FROM code WHERE regexp_matches(content, {q.lit(r.pattern)}) GROUP BY project" for r in CODE_RULES)),
)
def signals_by_file(spark, d):
    matched = F.array_compact(F.array(*[F.when(F.col("content").rlike(r.pattern), F.lit(r.rule_id)) for r in CODE_RULES]))
    return corpus.code_files(spark, d).select("project", F.explode(matched).alias("rule_id")).groupBy("rule_id", "project").agg(F.count("*").alias("files"))


# --- code units, design facts --------------------------------------------------------------

UNIT = r"function\s+(load_item_[A-Za-z0-9_]+)\s*\([^)]*\)\s*\{[^}]*\}"


@query(
    "code_units", "DET45",
    f"""WITH {q.CODE_CTE}, u AS (SELECT project, path, unnest(regexp_extract_all(content, {q.lit(UNIT)})) AS c FROM code WHERE lang = 'php'), n AS (SELECT project, path, c, regexp_extract(c, {q.lit(UNIT)}, 1) AS pattern_name FROM u WHERE length(c) <= 500)
SELECT project, path, pattern_name, substr(md5(c), 1, 8) AS code_hash, CASE WHEN contains(pattern_name, 'guard') OR contains(pattern_name, 'is_active') OR contains(c, 'function_exists') THEN 'security' WHEN contains(pattern_name, 'sanitize') OR contains(pattern_name, 'escape') THEN 'php-security'
 WHEN contains(pattern_name, 'get_product') OR contains(pattern_name, 'get_order') THEN 'item-api' WHEN contains(pattern_name, 'cache') OR contains(pattern_name, 'transient') THEN 'performance' ELSE 'utility' END AS category FROM n""",
)
def code_units(spark, d):
    return code.code_units(corpus.code_files(spark, d).filter("lang = 'php'"), UNIT)


# --- rewrites ------------------------------------------------------------------------------


@query(
    "replace_preview", "DET47",
    f"""WITH {q.CODE_LINES_CTE}, w AS (SELECT project, path, line_no, line, {_win(3, 3)} AS "before" FROM code_lines WHERE lang = 'php'), a AS (SELECT project, path, line_no, "before", regexp_replace("before", 'echo \\$(\\w+)', 'echo esc_html($\\1)', 'g') AS "after" FROM w WHERE regexp_matches(line, 'echo\\s+\\$'))
SELECT * FROM a WHERE "before" <> "after" """,
)
def replace_preview(spark, d):
    return code.replace_around(corpus.code_files(spark, d).filter("lang = 'php'"), r"echo\s+\$", r"echo \$(\w+)", r"echo esc_html(\$$1)")


@query(
    "wrapped_lines", "DET48",
    f"""WITH {q.CODE_LINES_CTE}, w AS (SELECT project, path, line_no, CASE WHEN regexp_matches(line, 'var_dump\\(') THEN regexp_extract(line, '^(\\s*)', 1) || 'if (DEBUG) {{ ' || regexp_replace(line, '^\\s+', '') || ' }}' ELSE line END AS l FROM code_lines WHERE lang = 'php' AND NOT regexp_matches(line, 'error_log'))
SELECT project, path, md5(string_agg(l, chr(10) ORDER BY line_no)) AS content_md5 FROM w GROUP BY ALL""",
)
def wrapped_lines(spark, d):
    files = code.delete_lines(corpus.code_files(spark, d).filter("lang = 'php'"), "error_log")
    out = code.wrap_lines(files, r"var_dump\(", "if (DEBUG) { ", " }")
    return out.select("project", "path", F.md5("content").alias("content_md5"))


@query(
    "verified_rewrites", "DET49",
    f"""WITH {q.CODE_LINES_CTE}, w AS (SELECT project, path, regexp_matches(line, 'echo\\s+\\$') AS o, regexp_matches(CASE WHEN regexp_matches(line, 'echo\\s+\\$name') THEN regexp_extract(line, '^(\\s*)', 1) || '// ' || regexp_replace(line, 'echo', 'print') ELSE line END, 'echo\\s+\\$') AS n FROM code_lines WHERE lang = 'php')
SELECT project, path, CAST(count(*) FILTER (WHERE o) AS INT) AS hits, CAST(count(*) FILTER (WHERE o AND n) AS INT) AS "left" FROM w GROUP BY ALL HAVING count(*) FILTER (WHERE o) > 0""",
)
def verified_rewrites(spark, d):
    files = corpus.code_files(spark, d).filter("lang = 'php'")
    fixed = files.withColumn("content", F.regexp_replace("content", r"echo(\s+\$name)", "print$1"))
    return code.unresolved_after(files, fixed, r"echo\s+\$")


# --- siblings and cross-file relations -----------------------------------------------------


@query(
    "sibling_violations", "DET17",
    f"""WITH {q.CODE_LINES_CTE}, f0 AS (SELECT project, regexp_replace(path, '/d[0-9]+/', '/') AS path, content FROM code), g AS (SELECT project, regexp_replace(path, '/[^/]*$', '') AS folder, bool_or(regexp_matches(content, 'save_order_3|useState')) AS uses FROM f0 WHERE regexp_matches(path, 'functions\\.') GROUP BY ALL),
m AS (SELECT c.project, c.path, regexp_replace(c.path, '/d[0-9]+/', '/') AS short, min(line_no) AS line_no FROM code_lines c WHERE regexp_matches(line, 'save_order_3|useState') GROUP BY ALL), p AS (SELECT m.project, m.path, m.line_no, arg_max(uses, length(folder)) AS uses FROM m JOIN g ON g.project = m.project AND starts_with(m.short, g.folder || '/') GROUP BY ALL)
SELECT project, count(*) AS violations, CAST(sum(line_no) AS BIGINT) AS line_sum FROM p WHERE NOT uses GROUP BY project""",
)
def sibling_violations(spark, d):
    files = corpus.code_files(spark, d)
    # The per-document folder is dropped, so that files of one kind share a folder.
    number = F.regexp_extract("path", "/d([0-9]+)/", 1)
    files = files.withColumn("path", F.concat(F.regexp_replace("path", "/d[0-9]+/", "/"), F.lit("#"), number))
    out = code.sibling_violations(files, r"functions\.", "save_order_3|useState")
    return out.groupBy("project").agg(F.count("*").alias("violations"), F.sum(F.col("line_no").cast("long")).alias("line_sum"))


CHANGED = "chg AS (SELECT * FROM code WHERE regexp_matches(path, '/tests/'))"
IMP = f"imp AS (SELECT DISTINCT project, path AS importer, unnest(regexp_extract_all(content, {q.lit(graph.IMPORT_TARGETS)}, 1)) AS target FROM code)"


def _changed(spark, d):
    files = corpus.code_files(spark, d)
    return files, files.filter(F.col("path").rlike("/tests/"))


@query(
    "importers", "JOI7",
    f"""WITH {q.CODE_CTE}, {CHANGED}, {IMP} SELECT project, importer, target FROM imp WHERE (project, target) IN (SELECT project, regexp_extract(path, '([^/]+)$', 1) FROM chg) AND regexp_extract(importer, '([^/]+)$', 1) <> target""",
)
def importers(spark, d):
    return graph.importers(*_changed(spark, d))


CALLS = f"""sy AS (SELECT DISTINCT project, unnest(regexp_extract_all(content, {q.lit(graph.DEFINED)}, 1)) AS symbol FROM chg),
cl AS (SELECT project, path, line_no, unnest(list_distinct(regexp_extract_all(line, {q.lit(graph.CALL_TOKENS)}, 1))) AS symbol FROM code_lines WHERE NOT regexp_matches(path, '/tests/')),
sc AS (SELECT project, path, symbol, count(*) AS calls, min(line_no) AS first_line, max(line_no) AS last_line FROM cl JOIN sy USING (project, symbol) GROUP BY ALL)"""


@query("symbol_callers", "JOI8", f"WITH {q.CODE_LINES_CTE}, {CHANGED}, {CALLS} SELECT * FROM sc")
def symbol_callers(spark, d):
    return graph.symbol_callers(*_changed(spark, d))


@query(
    "impact_risk", "JOI8",
    f"""WITH {q.CODE_LINES_CTE}, {CHANGED}, {CALLS} SELECT project, path, count(*) AS symbols, CAST(sum(calls) AS BIGINT) AS calls, CASE WHEN count(*) >= any_value(n) * 0.5 OR sum(calls) >= 5 THEN 'HIGH' WHEN sum(calls) >= 2 OR count(*) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM sc JOIN (SELECT project, count(*) AS n FROM sy GROUP BY project) USING (project) GROUP BY project, path""",
)
def impact_risk(spark, d):
    files, changed = _changed(spark, d)
    return graph.caller_risk(graph.symbol_callers(files, changed), changed)


@query(
    "dependency_edges", "JOI9",
    f"""WITH {q.CODE_CTE}, {IMP}, df AS (SELECT DISTINCT project, path, unnest(regexp_extract_all(content, {q.lit(graph.DEFINED)}, 1)) AS node FROM code), us AS (SELECT DISTINCT project, path, unnest(regexp_extract_all(content, {q.lit(graph.CALL_TOKENS)}, 1)) AS node FROM code)
SELECT project, kind, src, count(*) AS edges, min(dst) AS first_dst FROM (SELECT project, path AS src, node AS dst, 'defines' AS kind FROM df UNION ALL SELECT project, node, path, 'uses' FROM us WHERE (project, node) IN (SELECT project, node FROM df) UNION ALL SELECT project, target, importer, 'imports' FROM imp) GROUP BY ALL""",
)
def dependency_edges(spark, d):
    edges = graph.dependency_edges(corpus.code_files(spark, d))
    return edges.groupBy("project", "kind", "src").agg(F.count("*").alias("edges"), F.min("dst").alias("first_dst"))


@query(
    "caller_lines", "JOI8",
    f"""WITH {q.CODE_LINES_CTE}, {CHANGED}, {CALLS} SELECT project, path, symbol, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS lines FROM cl JOIN sy USING (project, symbol) GROUP BY ALL""",
)
def caller_lines(spark, d):
    return graph.caller_lines(*_changed(spark, d)).withColumn("lines", F.array_join("lines", ","))


@query(
    "change_risk", "JOI8",
    f"""WITH {q.CODE_LINES_CTE}, {CHANGED}, {CALLS}, fr AS (SELECT project, path, CASE WHEN count(*) >= any_value(n) * 0.5 OR sum(calls) >= 5 THEN 'HIGH' WHEN sum(calls) >= 2 OR count(*) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM sc JOIN (SELECT project, count(*) AS n FROM sy GROUP BY project) USING (project) GROUP BY project, path)
SELECT project, count(*) AS files, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium,
 CASE WHEN count(*) FILTER (risk_level = 'HIGH') >= 3 THEN 'CRITICAL' WHEN count(*) FILTER (risk_level = 'HIGH') >= 1 THEN 'HIGH' WHEN count(*) FILTER (risk_level = 'MEDIUM') >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk FROM fr GROUP BY project""",
)
def change_risk(spark, d):
    files, changed = _changed(spark, d)
    return graph.overall_risk(graph.caller_risk(graph.symbol_callers(files, changed), changed))


@query(
    "change_reach", "JOI7 JOI9",
    f"""WITH RECURSIVE {q.CODE_CTE}, {CHANGED}, {IMP}, ou AS MATERIALIZED (SELECT DISTINCT project, path, 's:' || unnest(regexp_extract_all(content, {q.lit(graph.DEFINED)}, 1)) AS gate FROM code UNION SELECT project, path, 'f:' || regexp_extract(path, '([^/]+)$', 1) FROM code),
it AS MATERIALIZED (SELECT DISTINCT project, 's:' || unnest(regexp_extract_all(content, {q.lit(graph.CALL_TOKENS)}, 1)) AS gate, path FROM code UNION SELECT project, 'f:' || target, importer FROM imp),
walk(project, node, distance) AS (SELECT project, 'p:' || path, 0 FROM chg UNION
 SELECT w.project, CASE WHEN g.gate IS NOT NULL THEN g.gate ELSE 'p:' || i.path END, w.distance + 1 FROM walk w LEFT JOIN ou g ON starts_with(w.node, 'p:') AND g.project = w.project AND 'p:' || g.path = w.node
 LEFT JOIN it i ON i.project = w.project AND i.gate = w.node WHERE w.distance < 12 AND (g.gate IS NOT NULL OR i.path IS NOT NULL))
SELECT project, substr(node, 3) AS path, CAST(min(distance) // 2 AS INT) AS distance FROM walk WHERE starts_with(node, 'p:') GROUP BY ALL""",
)
def change_reach(spark, d):
    files = corpus.code_files(spark, d)
    return graph.change_reach(files, files.filter(F.col("path").rlike("/tests/")))


# --- scalar functions ----------------------------------------------------------------------

_kw = " ".join(f"WHEN contains(lower(path), {q.lit(k)}) THEN {q.lit(v)}" for k, v in X.TASK_KEYWORDS.items())


@query(
    "task_types", "FUN2 FUN3",
    f"""WITH {q.CODE_CTE} SELECT CASE {_kw} WHEN ext = '.css' THEN 'fix_css' WHEN ext = '.js' THEN 'fix_js' ELSE 'generic' END AS task_type, regexp_extract(path, 'themes/([^/]*)', 1) AS theme, count(*) AS files FROM code GROUP BY ALL""",
)
def task_types(spark, d):
    files = corpus.code_files(spark, d)
    return files.groupBy(X.task_type(F.col("path"), F.col("ext")).alias("task_type"), X.theme_of(F.col("path")).alias("theme")).agg(F.count("*").alias("files"))


@query(
    "task_keywords", "FUN4",
    """WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(trim(text)), '[\\s,;/\\-_]+'), lambda x: length(x) >= 3) AS ws FROM benchmark)
SELECT item_id, CAST(len(list_distinct(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])))) AS INT) AS keywords,
 list_sort(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])))[1] AS first_keyword FROM w""",
)
def task_keywords(spark, d):
    kw = X.task_keywords(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", kw.alias("kw")).select("item_id", F.size("kw").alias("keywords"), F.array_min("kw").alias("first_keyword"))


@query(
    "max_nesting", "FUN8",
    f"""WITH {q.CODE_CTE}, br AS (SELECT path, string_split(regexp_replace(content, '[^\\[\\]{{}}()]', '', 'g'), '') AS cs FROM code), ch AS (SELECT path, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM br),
su AS (SELECT path, i, sum(CASE WHEN c IN ('{{', '[', '(') THEN 1 WHEN c IN ('}}', ']', ')') THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS s FROM ch)
SELECT path, CAST(max(l) AS INT) AS nesting FROM (SELECT path, s - least(0, min(s) OVER (PARTITION BY path ORDER BY i)) AS l FROM su) GROUP BY path""",
)
def max_nesting(spark, d):
    return corpus.code_files(spark, d).select("path", X.max_nesting(F.col("content")).alias("nesting"))


@query(
    "literal_patterns", "FUN11 FUN12",
    f"""WITH {q.CODE_LINES_CTE}, e AS (SELECT DISTINCT regexp_replace(substr({TRIMMED}, 1, 60), '([\\\\.^$|?*+()\\[\\]{{}}])', '\\\\\\1', 'g') AS pattern FROM code_lines WHERE line <> '')
SELECT pattern, pattern || '(?!.*(?:esc_html|a\\.b\\(c\\)))' AS refined FROM e""",
)
def literal_patterns(spark, d):
    lines = corpus.explode_lines(corpus.code_files(spark, d)).filter("line != ''")
    patterns = lines.select(X.escape_literal(F.btrim("line", F.lit(" \t\r\n"))).alias("pattern")).distinct()
    tokens = F.array(F.lit("esc_html"), F.lit("a.b(c)"))
    return patterns.select("pattern", X.negative_lookahead(F.col("pattern"), tokens).alias("refined"))


@query(
    "finding_suggestions", "SIM19",
    f"""WITH {q.CODE_LINES_CTE}, {_catalog_sql()}, c AS (SELECT path, pattern_id, count(*) AS n FROM h GROUP BY ALL), z AS (SELECT path, len(lines) AS lines FROM code)
SELECT path, pattern_id, n, greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(50 + n * 10, 90)::DOUBLE / 100 + CASE WHEN pattern_id = 'todo-comment' THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN lines > 200 THEN 0.2::DOUBLE ELSE 0 END)) AS confidence FROM c JOIN z USING (path)""",
)
def finding_suggestions(spark, d):
    hits = _catalog_hits(spark, d).groupBy("path", "pattern_id").agg(F.count("*").alias("n"))
    sizes = corpus.with_lines(corpus.code_files(spark, d)).select("path", F.size("lines").alias("lines"))
    return mining.finding_confidence(hits.join(sizes, "path"), F.col("pattern_id") == "todo-comment", large_file=200).select("path", "pattern_id", "n", "confidence")


