"""Queries over design tokens derived from the part table, and over design facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions import tokens as T
from siftmill.plans.registry import query
from siftmill.sources.tables import table

ROLES = ["success", "error", "info", "warning", "muted"]

# The token document of a part as JSON: colours in three notations, spacings and a nested scale.
DOC = """t0 AS (SELECT p_partkey AS id, p_type AS project, p_size, lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0') AS c6, lpad(lower(to_hex(p_partkey % 4096)), 3, '0') AS c3, lpad(lower(to_hex(p_partkey * 104729 % 4294967296)), 8, '0') AS c8,
 ['success', 'error', 'info', 'warning', 'muted'][CAST(p_size % 5 AS INT) + 1] AS role FROM part)"""


def _docs(spark, d):
    pk = F.col("p_partkey")

    def hexed(number, width):
        return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(number)), width, "0"))

    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("p_size") % 5 + 1)
    colors = F.create_map(F.lit("primary"), hexed(pk * 7919 % 16777216, 6), F.lit("accent"), hexed(pk % 4096, 3), role, hexed(pk * 104729 % 4294967296, 8))
    spacing = F.create_map(F.lit("sm"), F.concat(F.col("p_size"), F.lit("px")), F.lit("md"), F.concat(F.col("p_size") * 2, F.lit("px")), F.lit("auto"), F.lit("auto"))
    scale = F.create_map(F.lit("h"), spacing, F.lit("c"), colors)
    # Stored as JSON text and decoded again, as the tokens of a project arrive.
    docs = table(spark, d, "part").select(pk.alias("id"), F.col("p_type").alias("project"), "p_size", F.to_json(scale).alias("doc"))
    return docs.withColumn("nested", F.from_json("doc", "map<string,map<string,string>>")).withColumn("colors", F.col("nested")["c"]).withColumn("spacing", F.col("nested")["h"])


def rgb(v: str, w: str) -> str:
    if w == "3":
        parts = [f"CAST('0x' || repeat(substr({v}, {i}, 1), 2) AS INT)" for i in (1, 2, 3)]
    else:
        parts = [f"CAST('0x' || substr({v}, {i}, 2) AS INT)" for i in (1, 3, 5)]
    body = " || ', ' || ".join(parts)
    return f"'rgba(' || {body} || ', ' || printf('%.2f', CAST('0x' || substr({v}, 7, 2) AS INT)::DOUBLE / 255) || ')'" if w == "8" else f"'rgb(' || {body} || ')'"


@query(
    "token_units", "FUN13 FUN14",
    f"""WITH {DOC} SELECT id, {rgb('c6', '6')} AS primary_rgb, {rgb('c3', '3')} AS accent_rgb, {rgb('c8', '8')} AS role_rgb, (p_size::DOUBLE / 16) || 'rem' AS sm, (p_size * 2::DOUBLE / 16) || 'rem' AS md, 'auto' AS auto FROM t0""",
)
def token_units(spark, d):
    docs = _docs(spark, d)
    colors, spacing = T.map_values(F.col("colors"), T.hex_to_rgb), T.map_values(F.col("spacing"), T.px_to_rem)
    out = docs.select("id", colors.alias("c"), spacing.alias("s"))
    role = F.get(F.filter(F.map_keys("c"), lambda k: ~k.isin("primary", "accent")), F.lit(0))
    return out.select("id", F.col("c")["primary"].alias("primary_rgb"), F.col("c")["accent"].alias("accent_rgb"), F.try_element_at("c", role).alias("role_rgb"), F.col("s")["sm"].alias("sm"), F.col("s")["md"].alias("md"), F.col("s")["auto"].alias("auto"))


@query(
    "flat_tokens", "FUN15 FUN16",
    f"""WITH {DOC}, e AS (SELECT id, unnest([{{'k': '--h-sm', 'v': p_size || 'px'}}, {{'k': '--h-md', 'v': (p_size * 2) || 'px'}}, {{'k': '--h-auto', 'v': 'auto'}}, {{'k': '--c-primary', 'v': '#' || c6}}, {{'k': '--c-accent', 'v': '#' || c3}}, {{'k': '--c-' || role, 'v': '#' || c8}}]) AS e FROM t0)
SELECT id, string_agg(e.k || ':' || e.v, ';' ORDER BY e.k) AS css FROM e GROUP BY id""",
)
def flat_tokens(spark, d):
    entries = T.prefixed(T.flatten(F.col("nested")))
    return _docs(spark, d).select("id", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ";").alias("css"))


@query(
    "merged_tokens", "FUN17",
    f"""WITH {DOC} SELECT id, '#000000' AS primary_color, '#' || c3 AS accent, '#' || c8 AS role_color, CASE WHEN p_size % 2 = 0 THEN '#ffffff' END AS background FROM t0""",
)
def merged_tokens(spark, d):
    override = F.create_map(F.lit("primary"), F.lit("#000000"))
    extra = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("background"), F.lit("#ffffff"))).otherwise(F.create_map().cast("map<string,string>"))
    out = _docs(spark, d).select("id", "colors", T.merged(F.col("colors"), override, extra).alias("m"))
    role = F.get(F.filter(F.map_keys("colors"), lambda k: ~k.isin("primary", "accent")), F.lit(0))
    return out.select("id", F.col("m")["primary"].alias("primary_color"), F.col("m")["accent"].alias("accent"), F.try_element_at("m", role).alias("role_color"), F.try_element_at("m", F.lit("background")).alias("background"))


@query(
    "token_checks", "FUN18",
    f"""WITH {DOC} SELECT project, warnings, count(*) AS documents FROM (SELECT project, 'few_colors,few_type_scales,few_spacings' || ',missing:' || array_to_string(list_filter(['success', 'error', 'warning', 'info'], lambda c: c <> role), '+') AS warnings FROM t0) GROUP BY ALL""",
)
def token_checks(spark, d):
    docs = _docs(spark, d).withColumn("typography", F.create_map().cast("map<string,string>"))
    out = T.checks(docs, "colors", "spacing", "typography").filter("valid")
    return out.groupBy("project", F.array_join("warnings", ",").alias("warnings")).agg(F.count("*").alias("documents"))


@query("layout_hashes", "FUN20", f"WITH {DOC} SELECT substr(md5(array_to_string(list_sort(['primary', 'accent', role]), '|')), 1, 12) AS layout, count(*) AS documents FROM t0 GROUP BY 1")
def layout_hashes(spark, d):
    return _docs(spark, d).groupBy(T.layout_hash(F.col("colors")).alias("layout")).agg(F.count("*").alias("documents"))


@query(
    "design_facts", "DET46",
    """WITH s AS (SELECT c_mktsegment AS project, c_custkey AS id, '{''primary'': ''#' || lpad(lower(to_hex(c_custkey * 7919 % 16777216)), 6, '0') || ''', ''font_family'': ''' || CASE c_custkey % 3 WHEN 0 THEN 'Inter' WHEN 1 THEN 'Lora' ELSE 'Roboto' END || ''', ''md'': ''' || (600 + c_custkey % 7 * 8) || 'px'', ''huge'': ''9px'', ''--app-brand'': 1}' AS txt FROM customer)
SELECT id, regexp_extract(txt, '''primary''.*?''#([0-9A-Fa-f]{6})''', 1) AS primary_color, regexp_extract(txt, '''font_family''.*?''([^'']+)''', 1) AS font, array_to_string(list_transform(regexp_extract_all(txt, '''(?:sm|md|lg|xl|2xl)'':\\s*''[0-9]+px'''), lambda x: replace(x, '''', '')), ';') AS breakpoints,
 array_to_string(regexp_extract_all(txt, '''--app-([^'']+)''', 1), ';') AS variables, CASE project WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'BUILDING' THEN 'construction' WHEN 'FURNITURE' THEN 'furniture' WHEN 'MACHINERY' THEN 'industry' ELSE 'retail' END AS industry FROM s""",
)
def design_facts(spark, d):
    ck = F.col("c_custkey")
    font = F.when(ck % 3 == 0, "Inter").when(ck % 3 == 1, "Lora").otherwise("Roboto")
    text = F.concat(
        F.lit("{'primary': '#"), F.lpad(F.lower(F.hex(ck * 7919 % 16777216)), 6, "0"), F.lit("', 'font_family': '"), font, F.lit("', 'md': '"), 600 + ck % 7 * 8,
        F.lit("px', 'huge': '9px', '--app-brand': 1}"),
    )
    files = table(spark, d, "customer").select(ck.alias("id"), F.col("c_mktsegment").alias("project"), text.alias("content"))
    facts = config_facts(F.col("content"))
    industry = F.create_map(*[F.lit(x) for x in ("AUTOMOBILE", "auto", "BUILDING", "construction", "FURNITURE", "furniture", "MACHINERY", "industry")])
    return files.select("id", *[v.alias(n) for n, v in facts.items()], F.coalesce(F.try_element_at(industry, F.col("project")), F.lit("retail")).alias("industry"))


def config_facts(text):
    """Primary colour, font, breakpoints and variable names of a config text."""
    points = F.regexp_extract_all(text, F.lit(r"'(?:sm|md|lg|xl|2xl)':\s*'[0-9]+px'"), F.lit(0))
    return {
        "primary_color": F.regexp_extract(text, r"'primary'.*?'#([0-9A-Fa-f]{6})'", 1), "font": F.regexp_extract(text, r"'font_family'.*?'([^']+)'", 1),
        "breakpoints": F.array_join(F.transform(points, lambda p: F.replace(p, F.lit("'"), F.lit(""))), ";"),
        "variables": F.array_join(F.regexp_extract_all(text, F.lit("'--app-([^']+)'"), F.lit(1)), ";"),
    }




@query(
    "transformed_tokens", "UDF3",
    f"""WITH {DOC} SELECT id, '--auto:auto;--md:' || (p_size * 2::DOUBLE / 16) || 'rem;--sm:' || (p_size::DOUBLE / 16) || 'rem' AS css FROM t0""",
)
def transformed_tokens(spark, d):
    from siftmill.operators.extend import transformed

    rem = lambda df: df.withColumn("spacing", T.map_values(F.col("spacing"), T.px_to_rem))
    named = lambda df: df.withColumn("entries", T.prefixed(F.col("spacing")))
    text = lambda df: df.select("id", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["key"], e["value"])), ";").alias("css"))
    return transformed(_docs(spark, d), rem, named, text)
