"""The rule table: schema defaults, filters, scope globs and the plan-time rule objects.

Rules are a dimension of a few hundred rows. A scan turns them into literal expressions, so
they are read to the driver once, behind a size check; larger tables are scanned in batches of
rules (see ``operators.scan.scan_presence``), never cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.sources.tables import RULE_DDL

# Fixed values.
SEVERITIES = ["CRITICAL", "HIGH", "SUGGEST", "MEDIUM", "INFO"]
SKIPPED_TYPES = ["block", "pattern", "manual"]
ROOT_PREFIXES = ["packages/", "shared/", "themes/", "mu-plugins/"]
PLATFORM_CATEGORIES = {
    "wp": ["php-security", "db-schema"],
    "nextjs": ["nextjs-react", "ai-safety"],
}
MAX_PLAN_RULES = 50_000


@dataclass(frozen=True)
class Guard:
    """Drop a match when ``pattern`` occurs within the window around it."""

    pattern: str
    lines_before: int = 3
    lines_after: int = 0
    cross_file: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    severity: str = "HIGH"
    category: str = "code-quality"
    type: str = "presence"
    description: str = ""
    scope: str = "**/*"
    exclude: str | None = None
    exclude_path: str | None = None
    pre_check: str | None = None
    exclude_line: str | None = None
    scope_mode: str = "per_file"
    max_per_file: int = 0
    dedup: str = ""
    skip_empty_scope: bool = False
    cross_check: str | None = None
    cross_check_scope: str | None = None
    ignore_matches: tuple[str, ...] = field(default=())
    context_guard: Guard | None = None


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from JSON or Parquet with the explicit schema and the rule defaults."""
    reader = spark.read.schema(RULE_DDL)
    raw = reader.parquet(path) if path.endswith(".parquet") else reader.json(path)
    return with_defaults(raw)


def with_defaults(rules: DataFrame) -> DataFrame:
    """Defaults of a rule; rules of a skipped type or without a pattern are left out."""
    kind = F.regexp_replace(F.coalesce("type", F.lit("presence")), "_", "-")
    return (
        rules.filter(F.col("pattern").isNotNull())
        .withColumn("type", F.when(kind == "pattern-presence", "pattern_presence").otherwise(kind))
        .filter(~F.col("type").isin(SKIPPED_TYPES))
        .withColumn("severity", F.coalesce("severity", F.lit("HIGH")))
        .withColumn("scope", F.coalesce("scope", F.lit("**/*")))
        .withColumn("description", F.coalesce("description", F.lit("")))
        .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    )


def plan_rules(rules: DataFrame, max_rules: int = MAX_PLAN_RULES) -> list[Rule]:
    """Rules as plan-time objects, in id order."""
    found = rules.orderBy("rule_id").limit(max_rules + 1).collect()
    if len(found) > max_rules:
        raise ValueError(f"more than {max_rules} rules: scan them in slices of the rule table")
    out = []
    for row in found:
        g = row["context_guard"]
        guard = (
            Guard(g["pattern"], g["lines_before"] if g["lines_before"] is not None else 3, g["lines_after"] or 0, g["cross_file"])
            if g
            else None
        )
        out.append(
            Rule(
                rule_id=row["rule_id"], pattern=row["pattern"], severity=row["severity"],
                category=row["category"] or "", type=row["type"], description=row["description"],
                scope=row["scope"], exclude=row["exclude"], exclude_path=row["exclude_path"],
                pre_check=row["pre_check"], exclude_line=row["exclude_line"],
                scope_mode=row["scope_mode"] or "per_file", max_per_file=row["max_per_file"] or 0,
                dedup=row["dedup"] or "", skip_empty_scope=bool(row["skip_empty_scope"]),
                cross_check=row["cross_check"], cross_check_scope=row["cross_check_scope"],
                ignore_matches=tuple(row["ignore_matches"] or ()), context_guard=guard,
            )
        )
    return out


# --- filters over a rule table -------------------------------------------------------------


def severity_filter(rules: DataFrame, wanted: str = "ALL") -> DataFrame:
    """One severity or ALL; INFO rules only when asked for by name."""
    if wanted == "ALL":
        return rules.filter(F.col("severity") != "INFO")
    return rules.filter(F.col("severity") == wanted)


def platform_filter(rules: DataFrame, platform: str, categories: list[str] | None = None) -> DataFrame:
    """Rules for both platforms, for this one, or of a category that implies it."""
    implied = PLATFORM_CATEGORIES.get(platform, []) if categories is None else categories
    named = F.coalesce("platform", F.lit(""))
    return rules.filter(named.isin("both", platform) | F.coalesce("category", F.lit("")).isin(implied))


def stack_filter(rules: DataFrame, caps: Column) -> DataFrame:
    """``requires`` must meet the capabilities, ``conflicts`` must not; empty passes."""
    requires = F.coalesce("requires", F.array().cast("array<string>"))
    conflicts = F.coalesce("conflicts", F.array().cast("array<string>"))
    return rules.filter(
        ((F.size(requires) == 0) | F.arrays_overlap(requires, caps)) & ~F.arrays_overlap(conflicts, caps)
    )


def scope_type_filter(rules: DataFrame, scope_type: str) -> DataFrame:
    return rules.filter(F.array_contains("tags", scope_type) | F.array_contains("tags", "both"))


def drop_disabled(rules: DataFrame, disabled: DataFrame) -> DataFrame:
    return rules.join(disabled.select("rule_id"), "rule_id", "left_anti")


def scope_parts(scope: Column) -> Column:
    return F.filter(F.transform(F.split(scope, r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def is_root_level(scope: Column) -> Column:
    """Every part of the scope starts at one of the repository-root folders."""
    parts = scope_parts(scope)
    prefix = "^(" + "|".join(re.escape(p) for p in ROOT_PREFIXES) + ")"
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(prefix))


def rewrite_scope(scope: Column) -> Column:
    """Scope of one project: the ``themes/*/`` prefix stripped, repeated parts removed."""
    parts = F.transform(F.split(scope, r"\|"), lambda p: F.regexp_replace(F.trim(p), r"^themes/\*\*?/", ""))
    return F.array_join(F.array_distinct(parts), "|")


def keyword_search(
    rules: DataFrame, keyword: str, category: str | None = None, severity: str | None = None,
    platform: str | None = None, limit: int = 10, body: str = "body",
) -> DataFrame:
    """Rules whose title, pattern, category or body holds the keyword; first ``limit`` by id."""
    out = rules
    if category:
        out = out.filter(F.col("category") == category)
    if severity:
        out = out.filter(F.col("severity") == severity)
    if platform:
        out = out.filter(F.col("platform") == platform)
    text = F.lower(F.concat_ws(" ", "description", "pattern", "category", body))
    return out.filter(text.contains(keyword.lower())).orderBy("rule_id").limit(limit)


# --- scopes --------------------------------------------------------------------------------


def glob_regex(glob: str) -> str:
    """One glob of a scope as an anchored regex. ``**`` crosses folders, ``*`` does not."""
    glob = glob.strip()
    if "*" not in glob:
        return f"^{re.escape(glob)}(/.*)?$"
    out = ""
    for piece in re.split(r"(\*\*/|\*\*|\*)", glob):
        out += {"**/": "(.*/)?", "**": ".*", "*": "[^/]*"}.get(piece, re.escape(piece))
    return f"^{out}$"


def scope_regex(scope: str) -> str:
    if scope.strip() == "theme root":
        return r"^[^/]+$"
    return "|".join(glob_regex(p) for p in scope.split("|") if p.strip())


def exclude_regex(exclude: str) -> str:
    """Globs of an exclude list; here ``*`` crosses folders and a part may match at any depth."""
    out = []
    for part in exclude.split("|"):
        body = ".*".join(re.escape(p) for p in re.split(r"\*+", part.strip()))
        out.append(f"^(.*/)?{body}$")
    return "|".join(out)


def in_scope(path: Column, rule: Rule) -> Column:
    cond = F.lit(True) if rule.scope in ("**/*", "") else path.rlike(scope_regex(rule.scope))
    if rule.exclude:
        cond = cond & ~path.rlike(exclude_regex(rule.exclude))
    if rule.exclude_path:
        cond = cond & ~path.contains(rule.exclude_path)
    return cond
