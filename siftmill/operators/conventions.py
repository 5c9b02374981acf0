"""Conventions learned from a corpus: indent, names, imports, file names, test layout.

Each learner is counts over files or names; the dominant value and its share come from a
handful of rows per language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.scores import ratio
from siftmill.functions.text import case_class
from siftmill.operators.code import STYLE_LANGS, declared_names
from siftmill.operators.scan import strip
from siftmill.sources.corpus import with_lines


def dominant(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Most frequent value per key, its count and share; the smaller value wins a tie."""
    out = counts.groupBy(*keys).agg(F.sum(n).alias("total"), F.max_by(F.struct(value, n), F.struct(n, F.col(value))).alias("top"))
    share = ratio(F.col(f"top.{n}"), F.col("total"))
    return out.select(*keys, "total", F.col(f"top.{value}").alias(value), F.col(f"top.{n}").alias("count"), share.alias("confidence"))


def indent_styles(files: DataFrame) -> DataFrame:
    """Files by the indent of their first indented line: tab, 2, 4 or 8 spaces."""
    source = with_lines(files.filter(~F.col("lang").isin(STYLE_LANGS)))
    widths = F.transform(
        F.filter("lines", lambda x: x.rlike(r"^[ \t]")),
        lambda x: F.when(x.startswith("\t"), F.lit("tab")).otherwise(F.length(F.regexp_extract(x, "^( *)", 1)).cast("string")),
    )
    first = F.get(F.filter(widths, lambda w: w.isin("tab", "2", "4", "8")), F.lit(0))
    return source.select("project", first.alias("indent")).filter(F.col("indent").isNotNull()).groupBy("indent").agg(F.count("*").alias("n"))


def indent_convention(files: DataFrame) -> DataFrame:
    """Tabs when over 70 % of the indented files use them, else the main width when over 50 %."""
    counts = indent_styles(files)
    out = counts.agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("indent") == "tab", F.col("n")).otherwise(0)).alias("tabs"),
        F.max_by(F.struct("indent", "n"), F.when(F.col("indent") != "tab", F.struct("n", "indent"))).alias("top"),
    )
    tabs = ratio(F.col("tabs"), F.col("total"))
    width = ratio(F.col("top.n"), F.col("total"))
    pick = F.when(tabs > 0.7, F.struct(F.lit("tab").alias("indent"), tabs.alias("confidence"))).when(
        width > 0.5, F.struct(F.col("top.indent").alias("indent"), width.alias("confidence"))
    )
    return out.select(pick.alias("p")).filter(F.col("p").isNotNull()).select("p.indent", "p.confidence")


def naming_conventions(files: DataFrame, min_functions: int = 10, min_classes: int = 5, share: float = 0.6) -> DataFrame:
    """Dominant naming style of functions and of classes per language."""
    counts = declared_names(files).groupBy("lang", "kind", "case_class").agg(F.count("*").alias("n"))
    out = dominant(counts, ["lang", "kind"], "case_class")
    enough = F.when(F.col("kind") == "function", F.col("total") >= min_functions).otherwise(F.col("total") >= min_classes)
    return out.filter(enough & (F.col("confidence") >= share))


def naming_violations(files: DataFrame, conventions: DataFrame) -> DataFrame:
    """Names that break the convention of their language, with the line of the declaration."""
    names = declared_names(files, by_line=True)
    rules = conventions.select("lang", "kind", F.col("case_class").alias("expected"))
    return names.join(F.broadcast(rules), ["lang", "kind"]).filter(F.col("case_class") != F.col("expected")).select(
        "project", "path", "lang", "line_no", "kind", "name", "case_class", "expected"
    )


# Import statements by language.
IMPORT_LINES = {
    "python": r"^(?:from\s+(\S+)\s+import|import\s+(\S+))",
    "javascript": r"^import\s+.*?from\s+['\"]([^'\"]+)['\"]",
    "typescript": r"^import\s+.*?from\s+['\"]([^'\"]+)['\"]",
}


def _module(line: Column) -> Column:
    py = F.concat(F.regexp_extract(line, IMPORT_LINES["python"], 1), F.regexp_extract(line, IMPORT_LINES["python"], 2))
    js = F.regexp_extract(line, IMPORT_LINES["javascript"], 1)
    return F.when(F.col("lang") == "python", py).otherwise(js)


def import_styles(files: DataFrame, first_lines: int | None = None) -> DataFrame:
    """Per language: relative and absolute imports, grouped and flat files (three imports up).

    A file is grouped when a blank line stands right before one of its imports.
    """
    source = with_lines(files.filter(F.col("lang").isin(list(IMPORT_LINES))))
    lines = F.slice("lines", 1, first_lines) if first_lines else F.col("lines")
    modules = F.transform(lines, lambda x: _module(strip(x)))
    imports = F.filter(modules, lambda m: m != "")
    blank_before = F.transform(lines, lambda x, i: (i > 0) & (_module(strip(x)) != "") & (F.trim(F.get(lines, i - 1)) == ""))
    rows = source.select("lang", imports.alias("imports"), F.exists(blank_before, lambda b: b).alias("grouped"))
    many = F.size("imports") >= 3
    return rows.groupBy("lang").agg(
        F.sum(F.size(F.filter("imports", lambda m: m.startswith("."))).cast("long")).alias("relative"), F.sum(F.size("imports").cast("long")).alias("imports"),
        F.count_if(many & F.col("grouped")).alias("grouped"), F.count_if(many).alias("files"),
    )


def import_conventions(styles: DataFrame) -> DataFrame:
    """Style per language when over 60 % agree and there are ten cases."""
    rel, grp = ratio(F.col("relative"), F.col("imports")), ratio(F.col("grouped"), F.col("files"))

    def choice(share: Column, enough: Column, yes: str, no: str) -> Column:
        def pair(name: str, value: Column) -> Column:
            return F.struct(F.lit(name).alias("pattern"), value.alias("confidence"))

        return F.when(enough & (share > 0.6), pair(yes, share)).when(enough & (1 - share > 0.6), pair(no, 1 - share))

    found = F.array_compact(
        F.array(
            choice(grp, F.col("files") >= 10, "grouped_imports", "flat_imports"),
            choice(rel, F.col("imports") >= 10, "relative_imports", "absolute_imports"),
        )
    )
    return styles.select("lang", F.inline(found))


def file_naming(files: DataFrame) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    counts = files.select(stem.alias("stem")).filter(F.length("stem") >= 3).groupBy(case_class(F.col("stem")).alias("case_class")).agg(F.count("*").alias("n"))
    return dominant(counts, [], "case_class").filter((F.col("total") >= 20) & (F.col("confidence") >= 0.5))


def test_layout(files: DataFrame) -> DataFrame:
    """Per project: share of test files that live in a test folder."""
    base, folder = F.lower(F.regexp_extract("path", r"([^/]+)$", 1)), F.regexp_replace("path", "/[^/]*$", "")
    is_test = base.rlike("test|spec")
    apart = folder.rlike("test")
    out = files.filter(is_test).groupBy("project").agg(F.count("*").alias("tests"), F.count_if(apart).alias("separate"))
    share = ratio(F.col("separate"), F.col("tests"))
    layout = F.when(share > 0.7, "separate_tests").when(1 - share > 0.7, "colocated_tests")
    return out.withColumn("share_separate", share).withColumn("layout", layout)
