"""Names, paths, texts and code fragments as column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Path keyword to task type, first match wins.
TASK_KEYWORDS = {
    "checkout": "checkout_page",
    "cart": "cart_page",
    "product": "product_page",
    "single": "product_page",
    "home": "home_page",
    "index": "home_page",
    "archive": "archive_page",
    "search": "search_page",
    "account": "account_page",
    "login": "login_page",
    "thank": "thankyou_page",
    "order": "order_page",
    "wishlist": "wishlist_page",
    "dashboard": "dashboard_page",
    "hero": "hero_component",
    "header": "header_component",
    "footer": "footer_component",
}


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, also when used inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def case_class(name: Column) -> Column:
    """Naming style of an identifier."""
    under = name.contains("_")
    first = F.substring(name, 1, 1)
    upper_first = first.rlike(r"^\p{Lu}")
    lower_first = first.rlike(r"^\p{Ll}")
    return (
        F.when(under & (name == F.lower(name)), "snake_case")
        .when(under & (name == F.upper(name)), "UPPER_SNAKE")
        .when(name.contains("-"), "kebab-case")
        .when(upper_first & ~under, "PascalCase")
        .when(lower_first & ~under & name.rlike(r"\p{Lu}"), "camelCase")
        .when(name == F.lower(name), "lowercase")
        .otherwise("mixed")
    )


def task_type(path: Column, ext: Column) -> Column:
    """Task type of a path: first keyword it holds, else by extension."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(None).cast("string")
    for keyword, name in reversed(TASK_KEYWORDS.items()):
        out = F.when(low.contains(keyword), name).otherwise(out)
    return F.coalesce(out, F.when(ext == ".css", "fix_css").when(ext == ".js", "fix_js").otherwise("generic"))


def theme_of(path: Column) -> Column:
    found = F.regexp_extract(path, r"themes/([^/]*)", 1)
    return F.when(path.contains("themes/"), found).otherwise("unknown")


def task_keywords(task: Column) -> Column:
    """Words of three or more characters and the pairs of neighbouring ones."""
    found = F.filter(F.split(F.lower(F.trim(task)), r"[\s,;/\-_]+"), lambda w: F.length(w) >= 3)

    def with_pairs(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        pairs = F.transform(starts, lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
        return F.array_distinct(F.concat(words, pairs))

    return let(found, with_pairs)


def word_phrases(text: Column, n: int = 3) -> Column:
    """All runs of ``n`` words of a text, lower case."""
    found = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(words: Column) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return let(found, runs)


def max_nesting(code: Column) -> Column:
    """Deepest level of brackets; a closing bracket never goes below zero."""
    marks = F.split(F.regexp_replace(code, r"[^\[\]{}()]", ""), "")
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("deepest"))

    def step(acc: Column, c: Column) -> Column:
        level = F.when(c.isin("{", "[", "("), acc["level"] + 1).when(c.isin("}", "]", ")"), F.greatest(F.lit(0), acc["level"] - 1)).otherwise(acc["level"])
        return F.struct(level.alias("level"), F.greatest(acc["deepest"], level).alias("deepest"))

    return F.aggregate(marks, start, step, lambda acc: acc["deepest"])


def escape_literal(raw: Column, width: int | None = 60) -> Column:
    """The first ``width`` characters (None: all) as a pattern that matches them literally."""
    return F.regexp_replace(raw if width is None else F.substring(raw, 1, width), r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def negative_lookahead(pattern: Column, tokens: Column) -> Column:
    """The pattern, refused where any of the tokens follows on the line."""
    escaped = F.transform(tokens, lambda t: F.regexp_replace(t, r"([\\.^$|?*+()\[\]{}])", r"\\$1"))
    built = F.concat(pattern, F.lit("(?!.*(?:"), F.array_join(escaped, "|"), F.lit("))"))
    return F.when(F.size(tokens) > 0, built).otherwise(pattern)


def category_of_match(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\$_get|\$_post|\$_request|sql|query"), "php-security")
        .when(low.rlike(r"px|#|color|font"), "css-tokens")
        .when(low.rlike(r"fetch|axios|usestate|useeffect"), "js-contract")
        .otherwise("code-quality")
    )


def severity_of_confidence(confidence: Column, count: Column) -> Column:
    return F.when((confidence > 0.8) & (count >= 10), "CRITICAL").when((confidence > 0.6) & (count >= 5), "HIGH").otherwise("SUGGEST")


def tune_suggestion(phrase: Column, files: Column) -> Column:
    """What a recurring dismissal phrase suggests to change."""
    def has(*words: str) -> Column:
        cond = F.lit(True)
        for w in words:
            cond = cond & phrase.contains(w)
        return cond

    return (
        F.when(has("already", "called"), "exclude-parent-call")
        .when(has("false positive", "comment"), "exclude-comments")
        .when(has("test") | has("mock"), "exclude-tests")
        .when(has("third party") | has("vendor"), "exclude-vendor")
        .when(has("intentional") | has("by design"), "relax")
        .when(F.forall(files, lambda f: F.lower(f).contains("test")), "all-in-tests")
        .when(F.forall(files, lambda f: f.contains("vendor")), "all-in-vendor")
        .otherwise("review")
    )


def strip_comments(code: Column) -> Column:
    """Code without block comments and line comments (an address after a colon is kept)."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", ""), r"(?m)(?<!:)//[^\n]*|^\s*#[^\n]*", "")


def clean_tokens(tokens: Column, max_length: int = 200) -> Column:
    """Trimmed tokens in order, without repeats, over-long ones and unexpected characters."""
    trimmed = F.transform(tokens, lambda t: F.trim(t))
    good = F.filter(
        trimmed, lambda t: (F.length(t) > 0) & (F.length(t) <= max_length) & t.rlike(r"^[A-Za-z0-9_:$\[\]'\"\-./()]+$")
    )
    return F.array_distinct(good)


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.75, "CRITICAL").when(score >= 0.5, "HIGH").when(score >= 0.25, "MEDIUM").otherwise("LOW")


def fix_risk_score(fix: Column, file_size: Column, failures: Column, size_limits: tuple[int, int] = (1000, 500)) -> Column:
    """Risk that a fix fails: failure history, file size, fix size, syntax and dependencies.

    Each factor counts only above its limit, with its own weight.
    """
    lines = F.size(F.split(fix, "\n", -1))
    history = failures.cast("double") / (failures + 10)
    file_part = F.when(file_size > size_limits[0], 0.8).when(file_size > size_limits[1], 0.5).otherwise(0.2)
    size_part = F.when(lines > 100, 0.9).when(lines > 50, 0.7).when(lines > 20, 0.5).when(lines > 10, 0.3).otherwise(0.1)
    syntax_part = (
        F.when(max_nesting(fix) > 4, 30).otherwise(0)
        + F.when(fix.rlike(r"(?i)preg_match|preg_replace|regex"), 20).otherwise(0)
        + F.when(fix.rlike(r"(?i)SELECT|INSERT|UPDATE|DELETE"), 20).otherwise(0)
        + F.when(fix.rlike(r"function\s*\(|=>\s*\{"), 10).otherwise(0)
    ) / 100
    deps_part = F.when(fix.rlike(r"(?i)import |require|include|use "), 0.6).otherwise(0.0)

    def counted(part: Column, limit: float, weight: float) -> Column:
        return F.when(part > limit, part * weight).otherwise(0.0)

    return F.least(
        F.lit(1.0),
        counted(history, 0.3, 0.3) + counted(file_part, 0.5, 0.2) + counted(size_part, 0.5, 0.2)
        + counted(syntax_part, 0.5, 0.15) + counted(deps_part, 0.5, 0.15),
    )


