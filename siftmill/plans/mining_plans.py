"""Queries for similarity, mining, anomalies, fixes, vectors and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions.similarity import cosine, jaccard, token_set
from siftmill.operators import code, metrics, mining, ml, similarity
from siftmill.plans import concept_sql as C
from siftmill.plans import sqltext as q
from siftmill.plans.registry import query
from siftmill.plans.scan_plans import CODE_HITS_CTE, CODE_RULES, code_hits
from siftmill.sources import concepts, corpus
from siftmill.sources.tables import table

# DuckDB's levenshtein counts bytes; the accented letters of the corpus are mapped to one byte.
ACCENTS = "éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍáÁúÚàÀâÂôÔûÛîÎ"
_CODES = " || ".join(f"chr({c})" for c in [*range(1, 10), *range(11, 32), 91, 92, 93, 94, 95, 96][: len(ACCENTS)])


def plain(column: str) -> str:
    return f"translate({column}, {q.lit(ACCENTS)}, {_CODES})"


def toks(column: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'))"


def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0 END"


def lev(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 1 ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)::DOUBLE"


def r9(col):
    """Nine decimals, for values whose last bits depend on the order of additions."""
    return F.floor(col * 1e9 + 0.5) / 1e9


@query(
    "turn_similarity", "SIM1 SIM2 SIM3",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {plain('a.text')} AS x, {plain('b.text')} AS y, {toks('a.text')} AS tx, {toks('b.text')} AS ty, a.role = b.role AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
s AS (SELECT conv_id, turn, {jac('tx', 'ty')} AS token_overlap, {lev('x', 'y')} AS string_ratio, same FROM p)
SELECT conv_id, turn, token_overlap, string_ratio, string_ratio * 0.5::DOUBLE + token_overlap * 0.3::DOUBLE + CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.2::DOUBLE AS composite FROM s""",
)
def turn_similarity(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", "role")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"), F.col("role").alias("next_role"))
    pairs = t.join(nxt, ["conv_id", "turn"])
    scored = pairs.select(
        "conv_id", "turn", jaccard(token_set(F.col("text")), token_set(F.col("next_text"))).alias("token_overlap"),
        similarity.text_ratio(F.col("text"), F.col("next_text")).alias("string_ratio"), (F.col("role") == F.col("next_role")).alias("same"),
    )
    return scored.select("conv_id", "turn", "token_overlap", "string_ratio", similarity.composite(F.col("string_ratio"), F.col("token_overlap"), F.col("same")).alias("composite"))


# --- near-duplicate rules ------------------------------------------------------------------


def _doc_rules(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("pattern"), F.split("text", "\n", 2)[0].alias("title"), F.col("lang").alias("category"), (F.col("n_chars") % 100).alias("confidence")
    )


DUPS = f"""dr AS MATERIALIZED (SELECT doc_id AS id, text, {plain('text')} AS pattern, {toks("string_split(text, chr(10))[1]")} AS tk, lang AS category, n_chars % 100 AS confidence, n_chars FROM documents),
tp AS MATERIALIZED (SELECT * FROM (SELECT a.id AS a, b.id AS b, {jac('a.tk', 'b.tk')} AS j, a.pattern AS pa, b.pattern AS pb FROM dr a JOIN dr b ON a.id < b.id AND a.category = b.category) WHERE j > 0.66),
tq AS MATERIALIZED (SELECT * FROM tp WHERE (1 - abs(length(pa) - length(pb))::DOUBLE / greatest(length(pa), length(pb), 1)) * 0.5 + j * 0.3 + 0.2 >= 0.9 - 1e-12),
ed AS MATERIALIZED ({' UNION ALL '.join(f"SELECT a, b FROM (SELECT a, b, {lev('pa', 'pb')} * 0.5::DOUBLE + j * 0.3::DOUBLE + 0.2::DOUBLE AS s FROM tq WHERE (a + b) % 16 = {k}) WHERE s >= 0.9 - 1e-12" for k in range(16))}),
ud AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach(id, r) AS (SELECT a, a FROM ud UNION SELECT ud.b, reach.r FROM reach JOIN ud ON ud.a = reach.id WHERE reach.r < ud.b),
cl AS MATERIALIZED (SELECT id, min(r) AS cluster FROM reach GROUP BY id)"""


@query("duplicate_clusters", "SIM4", f"WITH RECURSIVE {DUPS} SELECT id, cluster FROM cl")
def duplicate_clusters(spark, d):
    return similarity.duplicate_clusters(_doc_rules(spark, d))


REPORT = f"""{DUPS}, rp AS (SELECT cl.cluster, count(*) + 1 AS members, count(*) AS duplicates, avg({lev('x.pattern', 'y.pattern')} * 0.5::DOUBLE + ({jac('x.tk', 'y.tk')}) * 0.3::DOUBLE + 0.2::DOUBLE) AS similarity FROM cl JOIN dr x ON x.id = cl.id JOIN dr y ON y.id = cl.cluster WHERE cl.id <> cl.cluster GROUP BY cl.cluster)"""


@query("duplicate_report", "SIM6", f"WITH RECURSIVE {REPORT} SELECT cluster, members, duplicates, floor(similarity * 1e9 + 0.5) / 1e9 AS similarity FROM rp")
def duplicate_report(spark, d):
    rules = _doc_rules(spark, d)
    return similarity.dedup_report(similarity.duplicate_clusters(rules), rules).withColumn("similarity", r9(F.col("similarity")))


@query(
    "merged_rules", "SIM5",
    f"""WITH RECURSIVE {DUPS}, m AS (SELECT cl.cluster, dr.* FROM cl JOIN dr USING (id)), p AS (SELECT cluster, arg_max(id, {{'c': confidence, 'i': -id}}) AS primary_rule, count(*) AS members FROM m GROUP BY cluster), t AS (SELECT DISTINCT cluster, text FROM m)
SELECT cluster, primary_rule, members, md5(CASE WHEN n > 1 THEN s ELSE o END) AS merged_md5 FROM p JOIN (SELECT cluster, count(*) AS n, string_agg('(' || text || ')', '|' ORDER BY text) AS s, min(text) AS o FROM t GROUP BY cluster) USING (cluster)""",
)
def merged_rules(spark, d):
    rules = _doc_rules(spark, d)
    out = similarity.merged_rules(similarity.duplicate_clusters(rules), rules)
    return out.select("cluster", F.col("primary").alias("primary_rule"), "members", F.md5("merged_pattern").alias("merged_md5"))


@query(
    "noisy_rules", "SIM7",
    f"WITH {CODE_HITS_CTE}, r(rule_id) AS (VALUES {', '.join('(' + q.lit(r.rule_id) + ')' for r in CODE_RULES)}) SELECT rule_id, coalesce(n, 0) AS hits, coalesce(n, 0) > 500 AS noisy FROM r LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits GROUP BY 1) USING (rule_id)",
)
def noisy_rules(spark, d):
    rules = spark.createDataFrame([(r.rule_id,) for r in CODE_RULES], "rule_id string")
    return similarity.noise_flags(code_hits(spark, d), rules, threshold=500)


@query(
    "guardrail_actions", "SIM8",
    f"""WITH RECURSIVE {REPORT}, cr AS (SELECT id, n_chars > 3000 AS noisy FROM dr WHERE id % 2 = 1), g AS (SELECT cluster, bool_or(id % 2 = 0) AS has_old FROM cl GROUP BY cluster),
j AS (SELECT cl.id, CASE WHEN similarity >= 0.9 AND has_old THEN 'merge' WHEN similarity >= 0.7 THEN 'disable' END AS act FROM cl JOIN rp USING (cluster) JOIN g USING (cluster) WHERE cl.id % 2 = 1)
SELECT action, count(*) AS rules FROM (SELECT coalesce(act, CASE WHEN noisy THEN 'demote' END, 'keep') AS action FROM cr LEFT JOIN j USING (id)) GROUP BY action""",
)
def guardrail_actions(spark, d):
    rules = _doc_rules(spark, d)
    clusters = similarity.duplicate_clusters(rules)
    created = rules.filter("id % 2 = 1").select("id")
    noise = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 3000).alias("noisy"))
    out = similarity.guardrail(similarity.dedup_report(clusters, rules), clusters, created, noise)
    return out.groupBy("action").agg(F.count("*").alias("rules"))


# --- vectors -------------------------------------------------------------------------------


@query(
    "neighbour_similarity", "SIM9",
    "SELECT a.vec_id, floor(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1e9 + 0.5) / 1e9 AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def neighbour_similarity(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", r9(cosine(F.col("embedding"), F.col("other"))).alias("similarity"))


@query(
    "semantic_relevance", "JOI15",
    "SELECT vec_id, floor(s * 1e9 + 0.5) / 1e9 AS similarity FROM (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = 0) WHERE s > 0.2",
)
def semantic_relevance(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    # The task vector is one row; it becomes a literal, so the scoring is a map over the vectors.
    task = e.filter("vec_id = 0").first()["embedding"]
    sim = cosine(F.col("embedding"), F.array(*[F.lit(x) for x in task]))
    return e.select("vec_id", sim.alias("s")).filter("s > 0.2").select("vec_id", r9(F.col("s")).alias("similarity"))


@query(
    "vector_clusters", "SIM10",
    """WITH RECURSIVE p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.38),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach(id, r) AS (SELECT a, a FROM u UNION SELECT u.b, reach.r FROM reach JOIN u ON u.a = reach.id WHERE reach.r < u.b) SELECT id, min(r) AS cluster FROM reach GROUP BY id""",
)
def vector_clusters(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similarity.vector_clusters(vectors, threshold=0.38)


# --- recurring patterns --------------------------------------------------------------------


def _texts(spark, d):
    hits = code_hits(spark, d)
    return hits.select(
        corpus.ext_of(F.col("path")).alias("ext"), F.col("match_text").alias("text"), "path", "line_no", mining.project_of_path(F.col("path")).alias("project"), mining.platform_of_path(F.col("path")).alias("platform")
    )


CLUST = f"""{CODE_HITS_CTE}, vt AS (SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, match_text AS text, regexp_extract(path, 'themes/([^/]+)', 1) AS project, CASE WHEN contains(path, '.php') THEN 'wp' WHEN regexp_matches(path, '\\.(tsx|jsx|ts|js)$') THEN 'nextjs' END AS platform, path FROM hits),
tx AS MATERIALIZED (SELECT ext, text, count(*) AS n FROM vt GROUP BY ALL), te AS (SELECT a.ext, a.text AS a, b.text AS b FROM tx a JOIN tx b ON a.ext = b.ext AND a.text < b.text WHERE {lev('a.text', 'b.text')} >= 0.8 - 1e-9),
tu AS MATERIALIZED (SELECT ext, a, b FROM te UNION SELECT ext, b, a FROM te), rc(ext, t, r) AS (SELECT ext, text, text FROM tx UNION SELECT tu.ext, tu.b, rc.r FROM rc JOIN tu ON tu.ext = rc.ext AND tu.a = rc.t WHERE rc.r < tu.b),
tc AS MATERIALIZED (SELECT ext, t AS text, min(r) AS cluster FROM rc GROUP BY ALL)"""


@query(
    "text_clusters", "SIM11 SIM13",
    f"""WITH RECURSIVE {CLUST}, g AS (SELECT tc.ext, cluster, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS texts, bool_or(regexp_matches(tc.text, '\\$_GET|\\$_POST|\\$_REQUEST')) AS f0, bool_or(regexp_matches(tc.text, '(?i)sql|query')) AS f1, bool_or(regexp_matches(tc.text, 'fetch|axios')) AS f3, bool_or(regexp_matches(tc.text, 'useState|useEffect')) AS f4 FROM tc JOIN tx ON tx.ext = tc.ext AND tx.text = tc.text GROUP BY ALL),
c AS (SELECT *, CASE WHEN ext = '.php' AND (f0 OR f1) THEN 'php-security' WHEN ext = '.js' AND f3 THEN 'js-contract' WHEN ext = '.js' AND f4 THEN 'nextjs-react' ELSE 'code-quality' END AS category FROM g)
SELECT ext, cluster AS first_text, occurrences, texts, category, CASE WHEN contains(category, 'security') THEN 'CRITICAL' WHEN occurrences >= 10 THEN 'HIGH' ELSE 'SUGGEST' END AS severity, least(1.0::DOUBLE, occurrences::DOUBLE / 10) AS confidence FROM c""",
)
def text_clusters(spark, d):
    found = mining.mined_patterns(_texts(spark, d), min_occurrences=1)
    return found.select("ext", F.col("example").alias("first_text"), "occurrences", "texts", "category", "severity", "confidence")


@query(
    "cross_project_patterns", "SIM14 SIM15",
    f"""WITH RECURSIVE {CLUST}, g AS (SELECT tc.ext, cluster, count(*) AS occurrences, count(DISTINCT project) AS projects, count(DISTINCT platform) AS platforms FROM vt JOIN tc ON vt.ext = tc.ext AND vt.text = tc.text GROUP BY ALL)
SELECT ext, cluster AS first_text, occurrences, projects, platforms > 1 AS universal, least(1.0::DOUBLE, least(1.0::DOUBLE, occurrences::DOUBLE / 10) * CASE WHEN platforms > 1 THEN 1.5::DOUBLE ELSE 1.2::DOUBLE END) AS confidence FROM g WHERE occurrences >= 2 AND projects >= 2""",
)
def cross_project_patterns(spark, d):
    texts = _texts(spark, d)
    found = mining.mined_patterns(texts)
    out = mining.mined_across_projects(texts, found, mining.text_clusters(texts))
    return out.select("ext", F.col("example").alias("first_text"), "occurrences", "projects", "universal", "confidence")


@query(
    "mined_patterns", "SIM11 SIM12 UDF4",
    f"""WITH RECURSIVE {CLUST}, g AS (SELECT tc.ext, cluster, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS texts, arg_min(tc.text, (length(tc.text), tc.text)) AS base, bool_or(regexp_matches(tc.text, '\\$_GET|\\$_POST|\\$_REQUEST')) AS f0, bool_or(regexp_matches(tc.text, '(?i)sql|query')) AS f1, bool_or(regexp_matches(tc.text, 'fetch|axios')) AS f3, bool_or(regexp_matches(tc.text, 'useState|useEffect')) AS f4 FROM tc JOIN tx ON tx.ext = tc.ext AND tx.text = tc.text GROUP BY ALL HAVING sum(n) >= 2),
places AS (SELECT ext, cluster, base, unnest(range(length(base))) AS i FROM g), subs AS (SELECT ext, cluster, i, k, substr(base, i + 1, k) AS sub FROM (SELECT *, unnest(range(1, length(base) - i + 1)) AS k FROM places)),
held AS (SELECT subs.ext, subs.cluster, i, k, sub FROM subs JOIN tc ON tc.ext = subs.ext AND tc.cluster = subs.cluster GROUP BY ALL HAVING bool_and(contains(tc.text, sub))),
best AS (SELECT ext, cluster, arg_max(sub, (k, -i)) AS common FROM held GROUP BY ALL),
c AS (SELECT g.*, coalesce(common, '') AS common, CASE WHEN g.ext = '.php' AND (f0 OR f1) THEN 'php-security' WHEN g.ext = '.js' AND f3 THEN 'js-contract' WHEN g.ext = '.js' AND f4 THEN 'nextjs-react' ELSE 'code-quality' END AS category FROM g LEFT JOIN best ON best.ext = g.ext AND best.cluster = g.cluster),
e AS (SELECT *, regexp_replace(common, '([\\\\.^$|?*+()\\[\\]{{}}])', '\\\\\\1', 'g') AS escaped FROM c WHERE length(common) >= 5 OR texts = 1)
SELECT ext, CASE WHEN texts = 1 THEN escaped ELSE '[a-zA-Z_][a-zA-Z0-9_]*?' || escaped || '[a-zA-Z_][a-zA-Z0-9_]*?' END AS pattern, '**/*' || ext AS scope, category,
 CASE WHEN contains(category, 'security') THEN 'CRITICAL' WHEN occurrences >= 10 THEN 'HIGH' ELSE 'SUGGEST' END AS severity, occurrences, texts, least(1.0::DOUBLE, occurrences::DOUBLE / 10) AS confidence FROM e""",
)
def mined_patterns(spark, d):
    return mining.mined_patterns(_texts(spark, d)).select("ext", "pattern", "scope", "category", "severity", "occurrences", "texts", "confidence")


_FP = ", ".join(f"({i}, {q.lit(r.pattern)})" for i, r in enumerate(CODE_RULES))


@query(
    "anomalies", "SIM16 FUN21 FUN22",
    f"""WITH {CODE_HITS_CTE}, fp(i, pat) AS (VALUES {_FP}), c AS (SELECT match_text AS text, count(*) AS occurrences, count(DISTINCT path) AS files, min(path) AS example_path FROM hits WHERE match_text <> '' GROUP BY 1 HAVING count(*) >= 3),
s AS (SELECT text, any_value(occurrences) AS occurrences, any_value(files) AS files, any_value(example_path) AS example_path, max({jac(toks('text'), toks('pat'))}) AS similarity FROM c, fp GROUP BY text),
x AS (SELECT *, least(1.0::DOUBLE, occurrences::DOUBLE / 10) * (1 - similarity) AS confidence FROM s WHERE similarity < 0.3)
SELECT *, CASE WHEN regexp_matches(lower(text), '\\$_get|\\$_post|\\$_request|sql|query') THEN 'php-security' WHEN regexp_matches(lower(text), 'px|#|color|font') THEN 'css-tokens' WHEN regexp_matches(lower(text), 'fetch|axios|usestate|useeffect') THEN 'js-contract' ELSE 'code-quality' END AS category,
 CASE WHEN confidence > 0.8 AND occurrences >= 10 THEN 'CRITICAL' WHEN confidence > 0.6 AND occurrences >= 5 THEN 'HIGH' ELSE 'SUGGEST' END AS severity FROM x WHERE confidence >= 0.5""",
)
def anomalies(spark, d):
    return mining.anomalies(_texts(spark, d), {r.rule_id: r.pattern for r in CODE_RULES})


@query("refined_patterns", "SIM17 AGG19 AGG20 FUN12")
def refined_patterns(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("rule_id"), F.col("text").alias("match_text"))
    feedback = docs.join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("is_fp")), "doc_id").drop("doc_id")
    rules = feedback.select("rule_id").distinct().withColumn("pattern", F.lit(r"[A-Z][a-z]+"))
    return mining.refined_patterns(feedback, rules, fp_threshold=0.1).drop("refined")


# --- fixes ---------------------------------------------------------------------------------

FIXES = f"""{q.CODE_CTE}, f0 AS (SELECT path, ext, lines AS bl, list_transform(lines, lambda x: regexp_replace(regexp_replace(x, 'echo \\$name;', 'echo esc_html($name);'), 'innerHTML = body', 'textContent = body')) AS al FROM code WHERE ext IN ('.php', '.js')),
f1 AS (SELECT path, ext, list_filter(bl, lambda x, i: NOT list_contains(al, x) AND list_position(bl, x) = i) AS bad, list_filter(al, lambda x, i: NOT list_contains(bl, x) AND list_position(al, x) = i) AS good FROM f0),
f2 AS (SELECT *, trim(array_to_string(bad, chr(10))) AS bad_code, trim(array_to_string(good, chr(10))) AS good_code, trim(bad[1]) AS first_bad FROM f1 WHERE len(bad) > 0 AND len(good) > 0),
f3 AS (SELECT *, count(*) OVER (PARTITION BY substr(bad_code, 1, 30)) AS seen FROM f2 WHERE length(bad_code) >= 5 AND length(good_code) >= 5)"""


def _edits(spark, d):
    files = corpus.with_lines(corpus.code_files(spark, d).filter(F.col("ext").isin(".php", ".js")))
    fixed = F.transform("lines", lambda x: F.regexp_replace(F.regexp_replace(x, r"echo \$name;", r"echo esc_html(\$name);"), "innerHTML = body", "textContent = body"))
    return files.select("project", "path", "ext", F.col("lines").alias("before_lines"), fixed.alias("after_lines"))


@query(
    "fix_candidates", "SIM18 FUN11",
    f"""WITH {FIXES}, s AS (SELECT path, ext, first_bad, bad_code, good_code, (CASE WHEN regexp_matches(bad_code, {q.lit(mining.REGEX_ABLE)}) THEN 3 ELSE 0 END + CASE WHEN seen >= 3 THEN 2 ELSE 0 END + CASE WHEN len(good) <= len(bad) * 3 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(bad_code, 'eval\\(') THEN 0 ELSE 2 END)::DOUBLE / 10 AS confidence,
 CASE WHEN regexp_matches(lower(first_bad), '\\$_get|\\$_post|\\$_request|eval\\(|base64_decode|select |insert |update |delete |echo \\$|print \\$|innerhtml') THEN 'security' WHEN regexp_matches(lower(first_bad), 'mysql_|deprecated') THEN 'deprecated' WHEN ext = '.js' THEN 'javascript' ELSE 'general' END AS category FROM f3)
SELECT path, regexp_replace(substr(first_bad, 1, 60), '([\\\\.^$|?*+()\\[\\]{{}}])', '\\\\\\1', 'g') AS pattern, '**/*' || ext AS scope, category, CASE WHEN category = 'security' THEN 'HIGH' ELSE 'SUGGEST' END AS severity, confidence, bad_code, good_code FROM s WHERE confidence >= 0.5""",
)
def fix_candidates(spark, d):
    return mining.fix_candidates(_edits(spark, d), [r"eval\("])


@query(
    "contextual_lessons", "SIM20",
    f"""WITH {FIXES}, t AS (SELECT path, CASE WHEN regexp_matches(good_code, 'wp_verify_nonce|check_ajax_referer') THEN 'add_nonce_check' WHEN regexp_matches(good_code, 'sanitize_text_field|esc_html|esc_attr|esc_url|wp_unslash') THEN 'add_sanitization' WHEN contains(good_code, 'is_wp_error') THEN 'add_error_handling' END AS fix_type FROM f3),
n AS (SELECT DISTINCT path, CASE WHEN regexp_matches(name, '^handle_.*_ajax') THEN 'ajax_handler' WHEN regexp_matches(name, '^process_.*_form') THEN 'form_handler' WHEN regexp_matches(name, '^save_.*') THEN 'save_handler' WHEN regexp_matches(name, '^delete_.*') THEN 'delete_handler' WHEN contains(name, 'Controller') THEN 'controller' WHEN contains(name, 'Service') THEN 'service' WHEN contains(name, 'Repository') THEN 'repository' ELSE 'generic' END AS context
 FROM (SELECT path, unnest(list_concat(regexp_extract_all(content, 'function\\s+([a-zA-Z_][A-Za-z0-9_]*)', 1), regexp_extract_all(content, '(?:class|interface|trait)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1))) AS name FROM code WHERE ext = '.php') WHERE length(name) > 2)
SELECT context, fix_type, count(*) AS lessons, count(DISTINCT path) AS files FROM n JOIN t USING (path) WHERE fix_type IS NOT NULL GROUP BY ALL""",
)
def contextual_lessons(spark, d):
    candidates = mining.fix_candidates(_edits(spark, d), [], min_confidence=0.0)
    names = code.declared_names(corpus.code_files(spark, d).filter("ext = '.php'"))
    return mining.contextual_lessons(names, candidates.select("path", F.col("good_code").alias("diff")))


# --- classifiers ---------------------------------------------------------------------------


def _rule_rows(spark, d):
    state = metrics.rule_state(concepts.feedback(spark, d)).withColumn("severity", concepts.rule_severity(F.col("rule_id")))
    state = metrics.with_confidence(state)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.concat("p_name", F.lit(".*("), "p_type", F.lit("|"), F.col("p_size"), F.lit(")+")).alias("pattern"))
    return ml.rule_features(state.join(parts, "rule_id"))


@query(
    "rule_features", "SIM21",
    f"""WITH {C.STATE} SELECT rule_id, CAST(length(pattern) AS INT) AS pattern_length, CAST(len(regexp_extract_all(pattern, '[.*+?\\[\\]{{}}()|\\\\^$]')) AS INT) AS special_chars, CAST(len(regexp_extract_all(pattern, '\\(')) AS INT) AS groups, false_positives::DOUBLE / greatest(total_hits, 1) AS fp_rate,
 true_positives::DOUBLE / greatest(total_hits, 1) AS tp_rate, fix_success::DOUBLE / greatest(fix_success + fix_failure, 1) AS fix_rate, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END AS severity_code
FROM state JOIN (SELECT p_partkey AS rule_id, p_name || '.*(' || p_type || '|' || p_size || ')+' AS pattern FROM part) USING (rule_id)""",
)
def rule_features(spark, d):
    return _rule_rows(spark, d).select("rule_id", *ml.RULE_FEATURES)


@query("rule_quality_model", "SIM22 SIM23")
def rule_quality_model(spark, d):
    rows = _rule_rows(spark, d).withColumn("label", F.when(F.col("confidence") > 0.7, 1.0).otherwise(0.0))
    train, test = ml.split_by_hash(rows, F.col("rule_id"))
    model = ml.train_forest(train, ml.RULE_FEATURES, "label")
    return ml.scored(model, test).select("rule_id", "label", "prediction", "quality")


def _page_predictions(spark, d):
    from siftmill.operators.html import FEATURES, html_features
    from siftmill.plans.html_plans import styled_pages

    pages = styled_pages(spark, d)
    labels = table(spark, d, "labels").select(F.concat(F.lit("page-"), "doc_id").alias("path"), F.col("quality").cast("double").alias("label"))
    rows = html_features(pages, F.lit("page")).join(labels, "path")
    train, test = ml.split_by_hash(rows, F.col("path"))
    return ml.scored(ml.train_forest(train, FEATURES, "label", depth=8, min_rows=1), test)


@query("component_classifier", "SIM25")
def component_classifier(spark, d):
    return ml.evaluation(_page_predictions(spark, d), "label")


@query("component_threshold", "SIM26")
def component_threshold(spark, d):
    return ml.best_probability_threshold(_page_predictions(spark, d), "label")
