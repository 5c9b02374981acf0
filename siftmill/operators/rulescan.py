"""One pass of a whole rule table over files: presence, absence and cross checks together.

A rule's regex can only match where one of its required literals stands. The literals of all
rules form one Aho-Corasick automaton, which reads a file once and names the rules that may
match in it; a rule is evaluated on the lines that hold its literal, and only there the regex
runs. Rules without a required literal are always evaluated. Every file yields an array of
events; what a rule says about a whole project is an event too, settled afterwards from the
events alone, so the files are read once whatever the number of rules.
"""

from __future__ import annotations

import re
import re._constants as sre  # the parse tree of a pattern
import re._parser
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators.scan import HIT_COLUMNS, IGNORE_TAG
from siftmill.session import arrow_batches, written_table
from siftmill.sources.corpus import with_lines
from siftmill.sources.rules import Rule, exclude_regex, scope_regex

HIT, TRIGGER, COMPANION, UNMET, MET = range(5)  # what an event says
BATCH_FILES = 256  # whole files that a Python worker holds at once
FEW_RULES = 64  # up to here literals are looked for one by one, without an automaton
EVENT = "array<struct<rule:int,kind:int,line_no:int,match_text:string>>"


# --- required literals ---------------------------------------------------------------------


def _alternatives(tree) -> tuple[str, ...] | None:
    """Literals of which every match of a parsed pattern holds one, the longest that can be had; None without any."""
    runs: list[tuple[str, ...]] = []
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if run:
            runs.append((run,))
            run = ""
        if op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            runs.append(_alternatives(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            runs.append(_alternatives(arg[2]))
        elif op is sre.BRANCH:
            parts = [_alternatives(branch) for branch in arg[1]]
            runs.append(None if None in parts else tuple(sorted({x for part in parts for x in part})))
    return max((r for r in runs if r), key=lambda r: min(map(len, r)), default=None)


@lru_cache(maxsize=None)
def required_literals(pattern: str) -> tuple[tuple[str, ...], bool]:
    """(literals, ignore case): every line that the pattern matches holds one of the literals. None are known for
    patterns that the parser of Python does not read or that turn case sensitivity off in part."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError):
        return (), False
    folded = bool(tree.state.flags & re.IGNORECASE)
    found = _alternatives(tree) or ()
    if tree.state.flags & re.VERBOSE or min(map(len, found), default=0) < 2:
        return (), False
    if folded and not all(x.isascii() for x in found):
        return (), False
    return (tuple(sorted({x.lower() for x in found})) if folded else found), folded


@lru_cache(maxsize=4)
def _automaton(words: tuple[tuple[str, int], ...]):
    import ahocorasick

    numbers: dict[str, list[int]] = {}
    for word, rule in words:
        numbers.setdefault(word, []).append(rule)
    automaton = ahocorasick.Automaton()
    for word, rules in numbers.items():
        automaton.add_word(word, tuple(rules))
    automaton.make_automaton()
    return automaton


def candidate_rules(rules: list[Rule]):
    """A column function: the numbers of the rules one of whose literals a text holds. Each text is read once, and once
    more in lower case where rules ignore case."""
    plain, folded = [], []
    for i, rule in enumerate(rules):
        words, ignore = required_literals(rule.pattern)
        (folded if ignore else plain).extend((w, i) for w in words)
    plain, folded = tuple(plain), tuple(folded)

    @F.pandas_udf("array<int>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                found: set[int] = set()
                for words, body in ((plain, text or ""), (folded, (text or "").lower())):
                    if words:
                        for _, numbers in _automaton(words).iter(body):
                            found.update(numbers)
                out.append(sorted(found))
            yield pd.Series(out)

    return held


# --- rules as SQL --------------------------------------------------------------------------


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _holds(text: str, pattern: str) -> str:
    """The pattern matches, its literals looked for first: a search in bytes, where a regex decodes the text."""
    words, ignore = required_literals(pattern)
    quick = " OR ".join(f"contains({text}, {_lit(w)})" for w in words) if words and not ignore else ""
    return f"({quick}) AND {text} RLIKE {_lit(pattern)}" if quick else f"{text} RLIKE {_lit(pattern)}"


def _any_line(pattern: str) -> str:
    return f"exists(numbered, h -> {_holds('h.x', pattern)})"


def _ignored(rule: Rule) -> str:
    tag, rid = IGNORE_TAG, rule.rule_id
    return (
        f"((contains(h.x, {_lit(tag)}) OR contains(h.x, 'nosec')) AND (contains(h.x, {_lit(f'{tag} {rid}')}) OR contains(h.x, {_lit(f'{tag} all')})"
        f" OR h.x RLIKE {_lit(r'#\s*nosec\b(?!\s*:)')} OR h.x RLIKE {_lit(rf'#\s*nosec\s*:\s*{re.escape(rid)}')}))"
    )


def _struct(number: int, kind: int | str, line_no: str = "0", text: str = "cast(null AS string)") -> str:
    return f"named_struct('rule', {number}, 'kind', {kind}, 'line_no', {line_no}, 'match_text', {text})"


def _hits(rule: Rule, number: int, kind: int, width: int, first: bool = False) -> str:
    keep = [_holds("h.x", rule.pattern), f"NOT {_ignored(rule)}"]
    if rule.exclude_line:
        keep.append(f"NOT (h.x RLIKE {_lit(rule.exclude_line)})")
    if rule.context_guard:
        g = rule.context_guard
        start = f"greatest(h.n - {g.lines_before}, 1)"
        keep.append(f"NOT (array_join(slice(lines, {start}, h.n + {g.lines_after} - {start} + 1), '\\n') RLIKE {_lit(g.pattern)})")
    text = f"substring(btrim(h.x, ' \\t\\r\\n'), 1, {width})"
    found = f"filter(numbered, h -> {' AND '.join(keep)})"
    cap = 1 if first or rule.dedup == "per_file" else rule.max_per_file
    return f"transform({f'slice({found}, 1, {cap})' if cap else found}, h -> {_struct(number, kind, 'h.n', text)})"


def _in_scope(rule: Rule) -> str:
    parts = [] if rule.scope in ("**/*", "") else [f"path RLIKE {_lit(scope_regex(rule.scope))}"]
    if rule.exclude:
        parts.append(f"NOT (path RLIKE {_lit(exclude_regex(rule.exclude))})")
    if rule.exclude_path:
        parts.append(f"NOT contains(path, {_lit(rule.exclude_path)})")
    tag = IGNORE_TAG
    parts.append(f"NOT (tagged AND exists(slice(lines, 1, 10), x -> contains(x, {_lit(f'{tag} {rule.rule_id}')}) OR contains(x, {_lit(f'{tag} all')})))")
    return " AND ".join(parts)


def events_of(rule: Rule, number: int, width: int, automaton: bool) -> str:
    """SQL for the events of one rule on a file (path, content, lines, numbered, tagged, held)."""
    hinted = automaton and bool(required_literals(rule.pattern)[0])
    may = f"array_contains(held, {number}) AND " if hinted else ""
    checks = " AND ".join([_in_scope(rule), *([_any_line(rule.pre_check)] if rule.pre_check and rule.type == "absence" else [])])
    if rule.type == "absence":
        found = f"({may}{_any_line(rule.pattern)})"
        if rule.scope_mode == "any":
            return f"CASE WHEN {checks} THEN array({_struct(number, f'if({found}, {MET}, {UNMET})')}) END"
        return f"CASE WHEN {checks} AND NOT ({found}) THEN array({_struct(number, HIT, text=_lit('Missing: ' + rule.pattern))}) END"
    if rule.cross_check and rule.cross_check_scope:
        target = f"path RLIKE {_lit(scope_regex(rule.cross_check_scope))} AND {_holds('content', rule.cross_check)}"
        own = f"CASE WHEN {may}{checks} THEN {_hits(rule, number, TRIGGER, width)} ELSE array() END"
        return f"concat({own}, CASE WHEN {target} THEN array({_struct(number, COMPANION)}) ELSE array() END)"
    if rule.cross_check:
        return f"CASE WHEN {may}{checks} AND NOT ({_holds('content', rule.cross_check)}) THEN {_hits(rule, number, HIT, width, first=True)} END"
    return f"CASE WHEN {may}{checks} THEN {_hits(rule, number, HIT, width)} END"


# --- the scan ------------------------------------------------------------------------------


def scan_events(files: DataFrame, rules: Iterable[Rule], width: int = 120, few: int = FEW_RULES) -> DataFrame:
    """(project, path, rule, kind, line_no, match_text): what every rule says about every file, in one narrow pass."""
    rules = list(rules)
    source = files if "lines" in files.columns else with_lines(files)
    wide = len(rules) > few
    held = candidate_rules(rules)(F.col("content")) if wide else F.lit(None).cast("array<int>")
    source = source.select("project", "path", "content", "lines", held.alias("held")).withColumn("numbered", F.expr("transform(lines, (x, i) -> struct(i + 1 AS n, x AS x))"))
    source = source.withColumn("tagged", F.expr(f"exists(slice(lines, 1, 10), x -> contains(x, {_lit(IGNORE_TAG)}))"))
    parts = ", ".join(events_of(rule, i, width, wide) for i, rule in enumerate(rules))
    events = F.expr(f"inline(flatten(array_compact(array({parts}))))") if rules else F.expr(f"inline(cast(array() AS {EVENT}))")
    return source.select("project", "path", events)


def scan_rules(files: DataFrame, rules: Iterable[Rule], width: int = 120, few: int = FEW_RULES) -> DataFrame:
    """Violations of all rules: presence, absence per file and anywhere, cross checks in the file and in another scope.

    ``absence`` rules report files without the pattern, or with ``scope_mode`` any the projects none of
    whose checked files holds it. A rule with ``cross_check`` reports its first line in files that lack
    the companion; with ``cross_check_scope`` besides, its lines in projects none of whose files of that
    scope holds it. The files are read once; events are written and settled per (project, rule).
    """
    rules = list(rules)
    spark = files.sparkSession
    with arrow_batches(spark, BATCH_FILES):
        events = written_table(scan_events(files, rules, width, few), "scan-events")
    told = events.filter(F.col("kind") >= COMPANION).groupBy("project", "rule").agg(F.max("kind").alias("most"))
    pending = events.filter(F.col("kind") == TRIGGER).join(told.filter(F.col("most") == COMPANION), ["project", "rule"], "left_anti")
    hits = events.filter(F.col("kind") == HIT).unionByName(pending).drop("kind")
    unmet = told.filter(F.col("most") == UNMET).select("project", "rule", F.lit(0).alias("line_no"))
    about = [(i, r.rule_id, r.severity, r.category, r.description, f"[NOT FOUND IN: {r.scope}]", f"Missing: {r.pattern}") for i, r in enumerate(rules)]
    labels = spark.createDataFrame(about, "rule int, rule_id string, severity string, category string, description string, whole string, missing string")
    unmet = unmet.join(F.broadcast(labels.select("rule", "whole", "missing")), "rule").select("project", F.col("whole").alias("path"), "rule", "line_no", F.col("missing").alias("match_text"))
    return hits.unionByName(unmet).join(F.broadcast(labels.drop("whole", "missing")), "rule").select("project", *HIT_COLUMNS)
