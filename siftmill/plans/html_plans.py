"""Queries over HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.operators import code, html as H
from siftmill.plans import sqltext as q
from siftmill.plans.registry import query
from siftmill.sources import corpus

# Every paragraph of a page is given a tag and classes chosen by its length, so that the pages
# hold markup to check; the derivation is one map per page.
CLASSES = [
    "bg-white text-gray-900", "hidden block p-2", "md:hidden block", "max-w-lg w-full", "md:grid-cols-2 p-4", "grid grid-cols-1 md:grid-cols-3 lg:grid-cols-4",
    "bg-white dark:bg-gray-900", "bg-gray-50 dark:bg-slate-700", "fixed absolute top-0", "py-4 md:py-8 rounded-lg shadow-md max-w-xl", "static relative md:flex",
    "border-gray-200", "py-2 rounded-full shadow-none lg:grid-cols-4 sm:grid-cols-2", "hero h-screen banner", "btn px-2 py-1 rounded-lg", "card shadow-md bg-white p-2 rounded-md",
    "text-gray-500 md:text-gray-700", "overflow-hidden flex carousel w-full",
]
TAGS = ["p", "section", "div", "a", "button"]


def styled_pages(spark, d):
    pages = corpus.spread(corpus.page_files(spark, d).select("project", "path", "page_id", "content"))
    tags, classes = (F.array(*[F.lit(x) for x in xs]) for xs in (TAGS, CLASSES))

    def dressed(s, i):
        pick = F.length(s) * 5 + i + F.col("page_id")
        tag = F.element_at(tags, (F.length(s) % len(TAGS)).cast("int") + 1)
        cls = F.element_at(classes, (pick % len(CLASSES)).cast("int") + 1)
        return F.when(i == 0, s).otherwise(F.concat(F.lit("<"), tag, F.lit(' class="'), cls, F.lit('">'), s))

    return pages.withColumn("content", F.array_join(F.transform(F.split("content", "<p>", -1), dressed), ""))


PAGES = f"""pages1 AS MATERIALIZED (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS project, 'page-' || page_id AS path, page_id, array_to_string(list_transform(string_split(html, '<p>'), lambda s, i: CASE WHEN i = 1 THEN s ELSE
 '<' || {q.sql_list(TAGS)}[CAST(length(s) % {len(TAGS)} AS INT) + 1] || ' class="' || {q.sql_list(CLASSES)}[CAST((length(s) * 5 + i - 1 + page_id) % {len(CLASSES)} AS INT) + 1] || '">' || s END), '') AS content FROM pages),
cls AS MATERIALIZED (SELECT project, path, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT project, path, regexp_extract_all(content, 'class="([^"]*)"', 1) AS cs FROM pages1))"""


def _conflict_sql() -> str:
    pre = "(?:(2xl|xl|lg|md|sm):)?"
    parts = [
        f"SELECT project, path, i, {k} AS k, {q.lit(n)} AS conflict, c FROM cls WHERE regexp_matches(c, {q.lit(a)}) AND regexp_matches(c, {q.lit(b)}) AND regexp_extract(c, {q.lit(pre + a)}, 1) = regexp_extract(c, {q.lit(pre + b)}, 1)"
        for k, (n, (a, b)) in enumerate(H.CONFLICTS.items())
    ]
    return f"WITH {PAGES}, h AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i, k) AS rn FROM h) SELECT project, path, conflict, substr(trim(c), 1, 100) AS match_text FROM r WHERE rn <= 10"


@query("class_conflicts", "DET14", _conflict_sql())
def class_conflicts(spark, d):
    return H.class_conflicts(styled_pages(spark, d))


def _dark_sql() -> str:
    parts = [
        f"SELECT project, path, i, {k} AS k, {q.lit(b)} AS base_class, c FROM t WHERE list_contains(ts, {q.lit(b)}) AND NOT list_has_any(ts, {q.sql_list(dk)}) AND len(list_filter(ts, lambda x: starts_with(x, 'dark:{b.split('-')[0]}-'))) = 0"
        for k, (b, dk) in enumerate(H.DARK_PAIRS.items())
    ]
    return f"WITH {PAGES}, t AS (SELECT *, string_split_regex(trim(c), '\\s+') AS ts FROM cls), h AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i, k) AS rn FROM h) SELECT project, path, base_class, substr(trim(c), 1, 100) AS match_text FROM r WHERE rn <= 10"


@query("missing_dark_variants", "DET15", _dark_sql())
def missing_dark_variants(spark, d):
    return H.missing_dark_variants(styled_pages(spark, d))


@query(
    "missing_base_styles", "DET16",
    f"""WITH {PAGES}, t AS (SELECT project, path, i, c, unnest(string_split_regex(trim(c), '\\s+')) AS tok FROM cls), p AS (SELECT *, regexp_extract(tok, '^(sm|md|lg|xl|2xl):', 1) AS pre, regexp_replace(tok, '^(sm|md|lg|xl|2xl):', '') AS prop FROM t),
g AS (SELECT project, path, i, c, prop, string_agg(pre, '/') AS prefixes, regexp_extract(prop, '^(.+)-[0-9]+$', 1) AS family FROM p WHERE pre <> '' AND regexp_matches(prop, 'grid-cols|py-') GROUP BY ALL)
SELECT project, path, prop AS property, prefixes, substr(trim(c), 1, 100) AS match_text FROM g WHERE family <> '' AND NOT EXISTS (SELECT 1 FROM p WHERE p.path = g.path AND p.i = g.i AND p.pre = '' AND (p.prop = g.prop OR starts_with(p.prop, g.family)))""",
)
def missing_base_styles(spark, d):
    return H.missing_base_styles(styled_pages(spark, d), "grid-cols|py-")


@query(
    "page_style_facts", "DET41",
    f"""WITH {PAGES}, v AS ("""
    + " UNION ALL ".join(
        f"SELECT project, path, {q.lit(k)} AS key, unnest(vs) AS value, generate_subscripts(vs, 1) AS i FROM (SELECT project, path, list_filter(regexp_extract_all(content, {q.lit(p)}, 1), lambda x: x NOT IN ('', 'none')) AS vs FROM pages1)"
        for k, p in code.STYLE_FACTS.items()
    )
    + """), c AS (SELECT project, path, key, value, CAST(count(*) AS INT) AS n, min(i) AS f FROM v GROUP BY ALL)
SELECT project, path, key, value, n FROM (SELECT *, row_number() OVER (PARTITION BY path, key ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""",
)
def page_style_facts(spark, d):
    return code.style_facts(styled_pages(spark, d))


def _component_sql() -> str:
    struct = {
        "contains_nav_or_logo": "regexp_matches(content, '<nav|class=\"[^\"]*logo')", "has_h1_and_button": "contains(content, '<h1') AND contains(content, '<button')",
        "icon_title_text": "regexp_matches(content, 'class=\"[^\"]*(icon|material-symbols)') AND regexp_matches(content, '<h[1-4]') AND contains(content, '<p')",
        "scrollable_items": "len(regexp_extract_all(content, '<li')) >= 3", "multiple_children": "len(regexp_extract_all(content, '<p')) >= 2", "has_heading": "regexp_matches(content, '<h[1-3]')", "in_nav": "contains(content, '<nav')",
        "multiple_clickable": "len(regexp_extract_all(content, '<(a|button)[ >]')) >= 2", "has_separators": "regexp_matches(regexp_replace(content, '<[^>]*>', '', 'g'), '[/>›]')", "has_inputs": "regexp_matches(content, '<(input|textarea|select)')",
    }
    flags = ", ".join(f"{c} AS f_{n}" for n, c in struct.items())
    parts = []
    for i, (kind, (tags, frs, st, place, minimum)) in enumerate(H.COMPONENTS.items()):
        score = f"CASE WHEN tag IN {q.sql_in(tags)} THEN 3 ELSE 0 END + least(4, {' + '.join(f'CASE WHEN contains(cls, {q.lit(f)}) THEN 1 ELSE 0 END' for f in frs) or '0'})"
        if st:
            cond = {"clickable": "tag IN ('button', 'a')", "small_inline": "regexp_matches(cls, 'inline|flex')", "expandable": "contains(cls, 'transition')"}.get(st, f"f_{st}")
            score += f" + CASE WHEN {cond} THEN 3 ELSE 0 END"
        if place:
            score += f" + CASE WHEN { {'top': 'pos < 10', 'bottom': 'pos >= nt - 10'}.get(place, 'pos = fs') } THEN 2 ELSE 0 END"
        parts.append(f"SELECT project, path, pos, tag, cls, {q.lit(kind)} AS component_type, least(10, {score}) AS score, {i} AS k, {minimum} AS m FROM e2")
    return f"""{PAGES}, tg AS (SELECT project, path, {flags}, regexp_extract_all(content, '<([A-Za-z][A-Za-z0-9]*)([^>]*)>', 0) AS ts FROM pages1), e0 AS (SELECT * EXCLUDE (ts), len(ts) AS nt, unnest(ts) AS t, CAST(generate_subscripts(ts, 1) - 1 AS INT) AS pos FROM tg),
e1 AS (SELECT *, lower(regexp_extract(t, '^<([A-Za-z0-9]+)', 1)) AS tag, regexp_extract(t, 'class="([^"]*)"', 1) AS cls FROM e0), e2 AS MATERIALIZED (SELECT *, min(CASE WHEN tag = 'section' THEN pos END) OVER (PARTITION BY path) AS fs FROM e1),
sc AS ({' UNION ALL '.join(parts)}), best AS (SELECT project, path, pos, tag, cls, component_type, score FROM (SELECT *, row_number() OVER (PARTITION BY path, pos ORDER BY score DESC, k) AS rn FROM sc WHERE score >= m) WHERE rn = 1)"""


COMP = _component_sql()


@query("page_components", "DET43 DET44", f"WITH {COMP} SELECT * FROM best")
def page_components(spark, d):
    return H.components_of(styled_pages(spark, d))


@query("component_counts", "DET43", f"WITH {COMP} SELECT component_type, count(*) AS elements, count(DISTINCT path) AS pages, CAST(sum(score) AS BIGINT) AS score_sum FROM best GROUP BY component_type")
def component_counts(spark, d):
    out = H.components_of(styled_pages(spark, d)).groupBy("component_type")
    return out.agg(F.count("*").alias("elements"), F.countDistinct("path").alias("pages"), F.sum("score").alias("score_sum"))


def _feature_sql() -> str:
    cnt = lambda t, s: f"((length({t}) - length(replace({t}, {q.lit(s)}, ''))) // {len(s)})"
    inter = " + ".join(cnt("lower(content)", f"<{t}") for t in H.INTERACTIVE_TAGS)
    sem = " + ".join(cnt("lower(content)", f"<{t}") for t in H.SEMANTIC_TAGS)
    flag = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    resp = "len(list_filter(cl, lambda c: regexp_matches(c, '^(sm|md|lg|xl|2xl):')))"
    vals = [
        "length(content)::DOUBLE / 1000", "tags", cnt("content", "class="), sem, "inter", flag("contains(content, 'flex')"), flag("contains(content, 'grid')"), flag("contains(content, 'container')"),
        "length(trim(regexp_replace(content, '<[^>]+>', '', 'g')))::DOUBLE / length(content)", "len(cl)::DOUBLE / greatest(tags, 1)", flag("regexp_matches(content, '<h[1-6]')"), flag("contains(content, '<img')"), flag("regexp_matches(content, '<ul|<ol')"),
        f"{cnt('content', '<div')} + {cnt('content', '<section')}", "4", flag(f"parent IN {q.sql_in(H.SEMANTIC_TAGS)}"), "len(regexp_extract_all(content, '>\\s*<'))::DOUBLE / 10", flag(f"{resp} > 0"), f"{resp}::DOUBLE / greatest(len(cl), 1)",
        flag("len(list_filter(cl, lambda c: regexp_matches(c, 'bg-|text-|border-'))) > 0"), flag("len(list_filter(cl, lambda c: regexp_matches(c, 'p-|px-|py-|m-|mx-|my-|gap-|space-'))) > 0"), flag("list_has_any(cl, ['w-full', 'w-screen', 'min-w-full'])"),
        flag("parent IN ('header', 'nav')"), flag("parent = 'footer'"), "inter::DOUBLE / greatest(tags, 1)",
    ]
    cols = ", ".join(f"({v})::DOUBLE AS {n}" for n, v in zip(H.FEATURES, vals))
    return f"""WITH {PAGES}, b AS (SELECT project, path, content, {cnt('content', '<')} AS tags, {inter} AS inter, regexp_extract(content, '<([A-Za-z0-9_]+)', 1) AS parent,
 list_filter(string_split_regex(array_to_string(regexp_extract_all(content, 'class="([^"]*)"', 1), ' '), '\\s+'), lambda c: c <> '') AS cl FROM pages1) SELECT project, path, {cols} FROM b"""


@query("page_features", "SIM24", _feature_sql())
def page_features(spark, d):
    return H.html_features(styled_pages(spark, d), F.lit("page"))


