"""Evaluating rules over files.

One pass evaluates all rules: each file row yields an array with one entry per hit, which is
exploded. No shuffle happens until a result crosses files. All rule regexes are literals, so
each is compiled once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import let
from siftmill.sources.corpus import with_lines
from siftmill.sources.rules import Rule, in_scope

IGNORE_TAG = "@scan-ignore"
RULES_PER_PASS = 400
HIT_COLUMNS = ["rule_id", "severity", "category", "description", "path", "line_no", "match_text"]


# --- suppression ---------------------------------------------------------------------------


def line_ignored(line: Column, rule_id: str, tag: str = IGNORE_TAG) -> Column:
    """Inline suppression: ``TAG rule``, ``TAG all``, ``# nosec`` and ``# nosec: rule``."""
    rid = re.escape(rule_id)
    return (
        line.contains(f"{tag} {rule_id}")
        | line.contains(f"{tag} all")
        | line.rlike(r"#\s*nosec\b(?!\s*:)")
        | line.rlike(rf"#\s*nosec\s*:\s*{rid}")
    )


def file_ignored(lines: Column, rule_id: str, tag: str = IGNORE_TAG) -> Column:
    """Suppression of a whole file by a tag in its first ten lines."""
    return F.exists(
        F.slice(lines, 1, 10), lambda x: x.contains(f"{tag} {rule_id}") | x.contains(f"{tag} all")
    )


def drop_dismissed(hits: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Remove hits dismissed globally, for their project, or for their file.

    ``dismissals`` holds ``(rule_id, scope, project, path, active)``; ``hits`` carry
    ``(rule_id, project, path)``. Three anti joins on equal keys; each is broadcast or shuffled by
    its measured size.
    """
    live = dismissals.filter("active")
    keys = {"global": ["rule_id"], "project": ["rule_id", "project"], "file": ["rule_id", "path"]}
    for scope, on in keys.items():
        part = live.filter(F.col("scope") == scope).select(*on).distinct()
        hits = hits.join(part, on, "left_anti")
    return hits


# --- presence ------------------------------------------------------------------------------


def window_text(lines: Column, line_no: Column, before: int, after: int) -> Column:
    start = F.greatest(line_no - before, F.lit(1))
    return F.array_join(F.slice(lines, start, line_no + after - start + 1), "\n")


def line_hits(lines: Column, rule: Rule) -> Column:
    """Array of ``(line_no, line)`` where the rule matches, after its line-level exclusions."""

    def keep(hit: Column) -> Column:
        line, no = hit["line"], hit["line_no"]
        cond = line.rlike(rule.pattern) & ~line_ignored(line, rule.rule_id)
        if rule.exclude_line:
            cond = cond & ~line.rlike(rule.exclude_line)
        if rule.context_guard:
            g = rule.context_guard
            cond = cond & ~window_text(lines, no, g.lines_before, g.lines_after).rlike(g.pattern)
        return cond

    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    hits = F.filter(numbered, keep)
    cap = 1 if rule.dedup == "per_file" else rule.max_per_file
    return F.slice(hits, 1, cap) if cap else hits


def _evaluate(lines: Column, path: Column, rules: list[Rule], width: int) -> Column:
    """Hits of all rules of a batch as one array, with the lines bound once per file."""

    def hits_of(bound: Column) -> Column:
        arrays = [
            F.when(in_scope(path, r) & ~file_ignored(bound, r.rule_id), _labelled(line_hits(bound, r), r, width)) for r in rules
        ]
        return F.flatten(F.array_compact(F.array(*arrays)))

    return let(lines, hits_of)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(" \t\r\n"))


def _labelled(hits: Column, rule: Rule, width: int) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.category).alias("category"),
            F.lit(rule.description).alias("description"),
            h["line_no"].alias("line_no"),
            F.substring(strip(h["line"]), 1, width).alias("match_text"),
        ),
    )


def _batches(rules: Iterable[Rule], size: int) -> Iterator[list[Rule]]:
    rules = list(rules)
    for i in range(0, len(rules), size):
        yield rules[i : i + size]


def scan_presence(files: DataFrame, rules: Iterable[Rule], width: int = 120) -> DataFrame:
    """Lines matching each rule within its scope, as violations. Shuffle-free."""
    keep = ["project"]
    source = files if "lines" in files.columns else with_lines(files)
    parts = []
    for batch in _batches(rules, RULES_PER_PASS):
        hits = _evaluate(F.col("lines"), F.col("path"), batch, width)
        parts.append(source.select(*keep, "path", F.explode(hits).alias("h")).select(*keep, "path", "h.*"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*keep, *HIT_COLUMNS)


def scan_must_not_exist(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The must-not-exist check: ten hits per file unless the rule says otherwise, 100 characters."""
    from dataclasses import replace

    capped = [replace(r, max_per_file=r.max_per_file or 10) for r in rules]
    return scan_presence(files, capped, width=100)


# --- absence -------------------------------------------------------------------------------


def _any_line(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda x: x.rlike(pattern))


def _checked_files(files: DataFrame, rule: Rule) -> DataFrame:
    source = files if "lines" in files.columns else with_lines(files)
    return source.filter(in_scope(F.col("path"), rule))


def _report(rule: Rule, **columns: Column) -> list[Column]:
    base = {
        "rule_id": F.lit(rule.rule_id), "severity": F.lit(rule.severity), "category": F.lit(rule.category),
        "description": F.lit(rule.description), "line_no": F.lit(0),
    }
    base.update(columns)
    return [base[c].alias(c) for c in HIT_COLUMNS]


def absence_per_file(files: DataFrame, rule: Rule) -> DataFrame:
    """Files in scope that pass the pre-check and hold no line with the required pattern."""
    found = _checked_files(files, rule).filter(~file_ignored(F.col("lines"), rule.rule_id))
    if rule.pre_check:
        found = found.filter(_any_line(F.col("lines"), rule.pre_check))
    missing = found.filter(~_any_line(F.col("lines"), rule.pattern))
    return missing.select(
        "project", *_report(rule, path=F.col("path"), match_text=F.lit(f"Missing: {rule.pattern}"))
    )


def absence_anywhere(files: DataFrame, rule: Rule) -> DataFrame:
    """One violation per project when no file in scope holds the pattern (one partial aggregate)."""
    checked = _checked_files(files, rule).filter(~file_ignored(F.col("lines"), rule.rule_id))
    pre = _any_line(F.col("lines"), rule.pre_check) if rule.pre_check else F.lit(True)
    seen = checked.groupBy("project").agg(
        F.bool_or(pre & _any_line(F.col("lines"), rule.pattern)).alias("hit"), F.bool_or(pre).alias("pre")
    )
    return seen.filter(~F.col("hit") & F.col("pre")).select(
        "project",
        *_report(
            rule, path=F.lit(f"[NOT FOUND IN: {rule.scope}]"), match_text=F.lit(f"Missing: {rule.pattern}")
        ),
    )


def empty_scope(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Rules whose scope names no file of a project, unless they allow it.

    One pass: a flag per rule is aggregated per project, then rules without a file are emitted.
    """
    rules = [r for r in rules if not r.skip_empty_scope]
    flags = files.groupBy("project").agg(
        F.array(*[F.bool_or(in_scope(F.col("path"), r)) for r in rules]).alias("seen")
    )
    out = F.array(*[F.struct(*_report(r, path=F.lit(f"[NO FILES MATCHING: {r.scope}]"),
                                      match_text=F.lit("Scope resolved to 0 files")), F.lit(i).alias("i"))
                    for i, r in enumerate(rules)])
    missing = F.filter(out, lambda s: ~F.element_at(F.col("seen"), s["i"] + 1))
    return flags.select("project", F.explode(missing).alias("h")).select("project", *[f"h.{c}" for c in HIT_COLUMNS])


def required_files(files: DataFrame, required: list[str], relative: Column, rule: Rule) -> DataFrame:
    """Required root files a project does not have. ``relative`` is the path within the project."""
    flags = files.groupBy("project").agg(
        F.array(*[F.bool_or(relative == p) for p in required]).alias("has")
    )
    missing = F.array_compact(
        F.transform(
            F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(required)]),
            lambda s: F.when(~F.element_at(F.col("has"), s["i"] + 1), s["p"]),
        )
    )
    return flags.select("project", F.explode(missing).alias("missing")).select(
        "project",
        *_report(rule, path=F.col("missing"), match_text=F.concat(F.lit("File does not exist: "), F.col("missing"))),
    )


def starts_with_bom(raw: Column) -> Column:
    """True when the raw bytes of a file begin with EF BB BF."""
    return F.hex(F.substring(raw, 1, 3)) == "EFBBBF"


# --- cross checks --------------------------------------------------------------------------


def cross_check_same_file(files: DataFrame, rule: Rule) -> DataFrame:
    """The first trigger line of a file whose text lacks the companion pattern."""
    source = _checked_files(files, rule).filter(~F.col("content").rlike(rule.cross_check))
    return scan_presence(source, [_first_only(rule)])


def _first_only(rule: Rule) -> Rule:
    from dataclasses import replace

    return replace(rule, dedup="per_file")


def cross_check_scope(files: DataFrame, rule: Rule, target: Column) -> DataFrame:
    """Trigger lines of the projects in which no target file holds the companion pattern."""
    has = (
        files.filter(target)
        .groupBy("project")
        .agg(F.bool_or(F.col("content").rlike(rule.cross_check)).alias("has"))
        .filter("has")
    )
    return scan_presence(_checked_files(files, rule), [rule]).join(has.select("project"), "project", "left_anti")


def undefined_references(files: DataFrame, rule: Rule, target: Column, token: str) -> DataFrame:
    """Symbols matched by the rule that no target file of the project mentions and the file
    itself does not declare.

    ``token`` is the regex that finds every mention in the target files; its matches are
    de-duplicated per project before the anti join, so a hot symbol costs one row.
    """
    source = with_lines(files) if "lines" not in files.columns else files
    hits = scan_presence(source, [rule])
    symbol = F.regexp_replace(F.regexp_extract("match_text", rule.pattern, 0), r"\($", "")
    hits = hits.withColumn("symbol", symbol).filter(~F.col("symbol").isin(list(rule.ignore_matches)))
    known = (
        source.filter(target)
        .select("project", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(token), F.lit(0)))).alias("symbol"))
        .distinct()
    )
    declared = source.select(
        "path",
        F.explode(
            F.array_distinct(F.regexp_extract_all("content", F.lit(r"function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))
        ).alias("symbol"),
    )
    return hits.join(known, ["project", "symbol"], "left_anti").join(declared, ["path", "symbol"], "left_anti")


# --- cross-file guard ----------------------------------------------------------------------


def guarded_partials(files: DataFrame, guard_pattern: str) -> DataFrame:
    """Partials exempt from a rule because a file that includes them holds the guard.

    Include targets are reduced to file names per project first, so that the join is on
    ``(project, name)`` and its build side has one row per name.
    """
    php = files.filter(F.col("path").endswith(".php"))
    names = F.array_distinct(
        F.array_union(
            F.transform(
                F.regexp_extract_all("content", F.lit(r"get_template_part\s*\(\s*['\"](?:[^'\"]*/)?([^'\"/]+)['\"]"), F.lit(1)),
                lambda n: F.concat(n, F.lit(".php")),
            ),
            F.regexp_extract_all("content", F.lit(r"(?:include|require)\s*\(\s*['\"](?:[^'\"]*/)?([^'\"/]+\.php)['\"]"), F.lit(1)),
        )
    )
    callers = (
        php.filter(F.col("content").rlike(guard_pattern))
        .select("project", "path", F.explode(names).alias("name"))
        .groupBy("project", "name")
        .agg(F.min("path").alias("first_caller"), F.max("path").alias("last_caller"))
    )
    partials = php.filter(F.col("path").rlike("template-parts|partials|components")).select(
        "project", "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
    )
    # A file does not exempt itself: some other caller must exist.
    return (
        partials.join(callers, ["project", "name"])
        .filter((F.col("first_caller") != F.col("path")) | (F.col("last_caller") != F.col("path")))
        .select("project", "path")
    )
