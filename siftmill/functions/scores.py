"""Small score, label and lookup expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def demoted(severity: Column) -> Column:
    """The next lower severity, null at the lowest."""
    return F.when(severity == "CRITICAL", "HIGH").when(severity == "HIGH", "SUGGEST")


def action_label(score: Column) -> Column:
    return (
        F.when(score >= 90, "TRUST").when(score >= 70, "USE_WITH_CARE").when(score >= 50, "REVIEW").otherwise("UNRELIABLE")
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 0).when(severity == "HIGH", 1).when(severity == "SUGGEST", 2).otherwise(9)


# Risk by (severity, category), fallback by severity, overrides by rule name.
RISK_MATRIX = {
    ("CRITICAL", "php-security"): 0.95,
    ("CRITICAL", "api-security"): 0.95,
    ("CRITICAL", "auth-security"): 0.95,
    ("HIGH", "php-security"): 0.85,
    ("HIGH", "api-security"): 0.85,
    ("HIGH", "auth-security"): 0.85,
    ("SUGGEST", "php-security"): 0.60,
    ("CRITICAL", "performance"): 0.80,
    ("CRITICAL", "db-schema"): 0.85,
    ("HIGH", "performance"): 0.60,
    ("HIGH", "db-schema"): 0.65,
    ("SUGGEST", "performance"): 0.40,
    ("CRITICAL", "code-quality"): 0.70,
    ("CRITICAL", "maintainability"): 0.65,
    ("HIGH", "code-quality"): 0.50,
    ("HIGH", "maintainability"): 0.45,
    ("SUGGEST", "code-quality"): 0.30,
    ("CRITICAL", "css-tokens"): 0.50,
    ("CRITICAL", "responsive"): 0.55,
    ("HIGH", "css-tokens"): 0.35,
    ("HIGH", "responsive"): 0.40,
    ("SUGGEST", "css-tokens"): 0.20,
    ("SUGGEST", "responsive"): 0.25,
    ("CRITICAL", "ads-compliance"): 0.80,
    ("CRITICAL", "seo"): 0.70,
    ("HIGH", "ads-compliance"): 0.65,
    ("HIGH", "seo"): 0.55,
    ("SUGGEST", "ads-compliance"): 0.45,
}
DEFAULT_RISK = {"CRITICAL": 0.75, "HIGH": 0.50, "SUGGEST": 0.30}
# Minutes by severity and factor by category.
BASE_EFFORT = {"CRITICAL": 15, "HIGH": 8, "SUGGEST": 5}
EFFORT_FACTOR = {
    "php-security": 1.5,
    "api-security": 1.5,
    "auth-security": 1.8,
    "db-schema": 2.0,
    "performance": 1.3,
    "code-quality": 0.8,
    "css-tokens": 0.6,
    "responsive": 0.7,
}
HIGH_RISK_CATEGORIES = ["php-security", "api-security", "auth-security", "performance"]
# Trust lost by kind of task.
COMPLEXITY_PENALTY = {
    "checkout_page": 0.05,
    "account_page": 0.05,
    "product_page": 0.03,
    "cart_page": 0.03,
    "order_page": 0.03,
    "fix_css": 0.0,
    "add_component": 0.0,
    "hero_component": 0.0,
    "header_component": 0.0,
    "footer_component": 0.0,
}


def lookup(mapping: dict, key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default)


def risk_score(severity: Column, category: Column, rule_id: Column) -> Column:
    """Risk of a finding: names first, then the matrix, then the severity."""
    name = F.lower(rule_id)
    by_pair = {f"{s}|{c}": v for (s, c), v in RISK_MATRIX.items()}
    fallback = lookup(DEFAULT_RISK, severity, F.lit(0.50))
    return (
        F.when(name.contains("schema") | name.contains("migration"), 0.90)
        .when(name.contains("auth") | name.contains("idor"), 0.95)
        .otherwise(lookup(by_pair, F.concat_ws("|", severity, category), fallback))
    )


def effort_minutes(severity: Column, category: Column, average: Column) -> Column:
    """Historical minutes of the rule, else base minutes times the category factor."""
    base = lookup(BASE_EFFORT, severity, F.lit(8)) * lookup(EFFORT_FACTOR, category, F.lit(1.0))
    return F.coalesce(average, base).cast("int")


def fix_regression_risk(severity: Column, category: Column) -> Column:
    """(level, probability) of a regression when the finding is fixed."""
    def pair(level: str, p: float) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(p).alias("probability"))

    return (
        F.when(severity == "CRITICAL", pair("HIGH", 0.7))
        .when(category.isin(HIGH_RISK_CATEGORIES), pair("MEDIUM", 0.5))
        .otherwise(pair("LOW", 0.3))
    )


def output_level(trust: Column, task_type: Column) -> Column:
    effective = trust - lookup(COMPLEXITY_PENALTY, task_type, F.lit(0.02))
    return (
        F.when(effective >= 0.95, "ready").when(effective >= 0.85, "draft").when(effective >= 0.6, "skeleton").otherwise("brief_only")
    )
