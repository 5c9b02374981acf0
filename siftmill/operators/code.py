"""Detectors over source code.

A file is one row, so a detector that looks at neighbouring lines slices the file's own line
array: no shuffle, no window over the corpus. Only counts across files shuffle, and they
combine map-side first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import case_class, let
from siftmill.operators.scan import strip
from siftmill.sources.corpus import with_lines

Test = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Detector:
    """``test(text, line_no, lines)`` says whether the trimmed line is a finding."""

    name: str
    test: Test
    lang: tuple[str, ...] = ()


def after(lines: Column, no: Column, k: int) -> Column:
    """The ``k`` lines after line ``no``."""
    return F.slice(lines, no + 1, k)


def around(lines: Column, no: Column, before: int, behind: int) -> Column:
    """Lines from ``before`` above to ``behind`` below, as one text."""
    first = F.greatest(no - before, F.lit(1))
    return F.array_join(F.slice(lines, first, no + behind - first + 1), "\n")


def any_match(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda x: x.rlike(pattern))


def detect(files: DataFrame, detectors: list[Detector], keep: tuple[str, ...] = ("project", "path", "lang")) -> DataFrame:
    """Findings of all detectors: one row per (file, line, detector)."""
    source = with_lines(files) if "lines" not in files.columns else files

    def found(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), strip(x).alias("text")))

        def hits(rows: Column) -> Column:
            parts = []
            for d in detectors:
                labelled = F.transform(F.filter(rows, _tester(d, lines)), _labeller(d.name))
                parts.append(F.when(F.col("lang").isin(list(d.lang)), labelled) if d.lang else labelled)
            return F.flatten(F.array_compact(F.array(*parts)))

        return let(numbered, hits)

    return source.select(*keep, F.explode(let(F.col("lines"), found)).alias("h")).select(*keep, "h.*")


def _tester(detector: Detector, lines: Column) -> Callable[[Column], Column]:
    return lambda row: detector.test(row["text"], row["line_no"], lines)


def _labeller(name: str) -> Callable[[Column], Column]:
    return lambda row: F.struct(F.lit(name).alias("pattern_id"), row["line_no"].alias("line_no"), row["text"].alias("line"))


def matches(pattern: str, without: str | None = None) -> Test:
    """Line test: the pattern is found and ``without`` is not."""
    def test(text: Column, no: Column, lines: Column) -> Column:
        hit = text.rlike(pattern)
        return hit & ~text.rlike(without) if without else hit

    return test


def unfollowed(pattern: str, handler: str, within: int) -> Test:
    """Line test: the pattern is found and none of the next lines holds the handler."""
    return lambda text, no, lines: text.rlike(pattern) & ~any_match(after(lines, no, within), handler)


# Server-side and client-side line patterns.
SERVER_PATTERNS = {
    "hardcoded_credentials": (r"(?i)(password|secret|api_key|token)\s*=\s*[\"'][^\"']+[\"']", None),
    "sql_injection": (r"\$wpdb->(query|prepare|get_results).*\.\s*\$", None),
    "xss_risk": (r"echo\s+\$|print\s+\$", r"esc_"),
    "missing_nonce": (r"isset\(\$_POST", r"wp_verify_nonce"),
    "file_inclusion": (r"(include|require)(_once)?\s*\(\s*\$", None),
    "hardcoded_url": (r"(?i)https?://[a-z0-9.-]+\.[a-z]{2,}", r"home_url|site_url"),
    "deprecated_mysql_query": (r"mysql_query", None),
    "deprecated_ereg": (r"ereg", None),
    "deprecated_split": (r"split", None),
    "deprecated_create_function": (r"create_function", None),
    "inefficient_loop": (r"for.*count\(|while.*count\(", None),
    "missing_sanitization": (r"\$_(GET|POST|REQUEST)\[", r"sanitize_|absint|intval|esc_"),
}
CLIENT_PATTERNS = {
    "hardcoded_api_key": (r"(?i)(apiKey|api_key|API_KEY|token|TOKEN)\s*[:=]\s*[\"'][^\"']{20,}[\"']", None),
    "eval_usage": (r"\beval\s*\(", None),
    "innerhtml_xss": (r"innerHTML", r"(?i)sanitize"),
    "console_log_production": (r"console\.(log|debug|info)\(", None),
}
UNCHECKED_CALL = (r"(file_get_contents|curl_exec|wp_remote_get)\(", r"is_wp_error|if", 3)
UNCHECKED_FETCH = (r"(fetch|axios)\s*\(", r"catch", 3)

SERVER_DETECTORS = [Detector(n, matches(p, w), ("php",)) for n, (p, w) in SERVER_PATTERNS.items()] + [
    Detector("missing_error_handling", unfollowed(*UNCHECKED_CALL), ("php",))
]
CLIENT_DETECTORS = [Detector(n, matches(p, w), ("javascript", "typescript")) for n, (p, w) in CLIENT_PATTERNS.items()] + [
    Detector("missing_fetch_error", unfollowed(*UNCHECKED_FETCH), ("javascript", "typescript"))
]


def catalog_detector(entry: dict) -> Detector:
    """A catalogue entry as a detector: detect, exclude, and a context to be found in the
    following lines. Comment lines are skipped."""
    flags = "(?i)" if entry.get("case_insensitive") else ""

    def test(text: Column, no: Column, lines: Column) -> Column:
        cond = ~text.rlike(r"^(#|\"\"\"|''')") & text.rlike(flags + entry["detect"])
        if entry.get("detect_exclude"):
            cond = cond & ~text.rlike(entry["detect_exclude"])
        if entry.get("detect_context_lines") and entry.get("detect_context_match"):
            cond = cond & around(lines, no, 0, entry["detect_context_lines"]).rlike(entry["detect_context_match"])
        return cond

    return Detector(entry["id"], test, tuple(entry.get("languages", ())))


# --- flow approximations -------------------------------------------------------------------

# What protects a read-modify-write.
LOCKS = r"(?i)BEGIN|START TRANSACTION|LOCK TABLES|wp_cache_add\(|->beginTransaction\(|atomic|LOCK IN SHARE MODE|FOR UPDATE"


def _unlocked(pattern: str, behind: int = 5) -> Test:
    return lambda text, no, lines: text.rlike(pattern) & ~around(lines, no, 4, behind).rlike(LOCKS)


def _option_race(text: Column, no: Column, lines: Column) -> Column:
    return (
        text.rlike(r"\$[A-Za-z0-9_]+\s*=\s*get_option\([^)]+\)")
        & any_match(after(lines, no, 10), r"update_option\([^)]+,\s*\$[A-Za-z0-9_]+")
        & ~around(lines, no, 4, 15).rlike(LOCKS)
    )


RACE_DETECTORS = [
    Detector("race_stock", _unlocked(r"(stock|quantity|inventory)\s*-=\s*[0-9]+")),
    Detector("race_usage", _unlocked(r"usage_count\s*\+=\s*1")),
    Detector("race_option", _option_race),
]
RACE_RISK = {"race_stock": "CRITICAL", "race_usage": "HIGH", "race_option": "MEDIUM"}


def _async_without_try(text: Column, no: Column, lines: Column) -> Column:
    """An async function whose body, up to the next closing line, awaits without try.

    The body ends at the first line that starts with a brace; when another async function
    starts before that, the later one owns the closing line.
    """
    rest = F.slice(lines, no, F.size(lines))
    flags = F.transform(rest, lambda x, i: F.when(x.rlike(r"^\s*\}"), i + 1))
    end = F.array_min(F.array_compact(flags))

    def judge(e: Column) -> Column:
        body = F.slice(rest, 1, e)
        later = F.exists(F.slice(body, 2, e), lambda x: x.rlike(ASYNC_START))
        whole = F.array_join(body, "\n")
        return e.isNotNull() & ~later & whole.contains("await") & ~whole.contains("try")

    return text.rlike(ASYNC_START) & F.coalesce(let(end, judge), F.lit(False))


ASYNC_START = r"async\s+(function|[A-Za-z0-9_]+\s*\()"
ASYNC_DETECTORS = [
    Detector("then_without_catch", lambda text, no, lines: text.rlike(r"\.then\(") & ~around(lines, no, 0, 5).contains(".catch(")),
    Detector("fetch_without_handler", lambda text, no, lines: text.rlike(r"fetch\(") & ~around(lines, no, 0, 10).rlike(r"(\.catch\(|try\s*\{)")),
    Detector("await_without_try", _async_without_try),
]

# Where tainted data comes from, what cleans it and where it must not go.
TAINT_SOURCE = r"\$([A-Za-z0-9_]+)\s*=\s*\$_(?:GET|POST|REQUEST|SERVER)"
SANITIZERS = [
    "sanitize_text_field", "sanitize_email", "sanitize_url", "esc_html", "esc_attr", "esc_url", "esc_js",
    "absint", "intval", "floatval",
]
SINKS = {
    "echo": "XSS",
    "print": "XSS",
    "$wpdb->query": "SQL Injection",
    "$wpdb->get_results": "SQL Injection",
    "$wpdb->insert": "SQL Injection",
    "file_get_contents": "Path Traversal",
    "file_put_contents": "Path Traversal",
    "include": "File Inclusion",
    "require": "File Inclusion",
    "eval": "Code Injection",
    "system": "Command Injection",
    "exec": "Command Injection",
    "shell_exec": "Command Injection",
}
INJECTIONS = ["SQL Injection", "Command Injection", "Code Injection"]


DIRECT_INPUT = r"\$_(?:GET|POST|REQUEST|SERVER)\[['\"]?[A-Za-z0-9_]+['\"]?\]"


def direct_flows(files: DataFrame) -> DataFrame:
    """(project, path, line_no, input, sink, risk): request input that stands in the line of a sink without a cleaning call,
    no variable in between. A narrow map."""
    source = with_lines(files) if "lines" not in files.columns else files
    clean = "|".join(SANITIZERS)
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text")))
    open_lines = F.filter(numbered, lambda r: r["text"].contains("$_") & r["text"].rlike(DIRECT_INPUT) & ~r["text"].rlike(clean))
    rows = source.select("project", "path", F.inline(open_lines))
    inputs = F.array_distinct(F.regexp_extract_all("text", F.lit(DIRECT_INPUT), F.lit(0)))
    kinds = F.array_compact(F.array(*[F.when(F.col("text").contains(s), F.struct(F.lit(s).alias("sink"), F.lit(r).alias("risk"))) for s, r in SINKS.items()]))
    return rows.select("project", "path", "line_no", F.explode(inputs).alias("input"), kinds.alias("kinds")).select("project", "path", "line_no", "input", F.inline("kinds"))


def taint_flows(files: DataFrame) -> DataFrame:
    """Variables assigned from a request that reach a sink without a cleaning call in between.

    The latest assignment before the sink counts; a cleaning line at or after it clears the
    variable until it is assigned again.
    """
    source = with_lines(files) if "lines" not in files.columns else files
    clean = "|".join(SANITIZERS)

    def flows(lines: Column) -> Column:
        assigned = F.filter(
            F.transform(lines, lambda x, i: F.struct((i + 1).alias("no"), F.regexp_extract(x, TAINT_SOURCE, 1).alias("var"))),
            lambda s: s["var"] != "",
        )

        def reach(sources: Column) -> Column:
            names = F.array_distinct(F.transform(sources, lambda s: s["var"]))
            sinks = F.filter(
                F.transform(lines, lambda x, i: F.struct((i + 1).alias("no"), x.alias("text"))),
                lambda r: _any_contains(r["text"], list(SINKS)),
            )

            def of_line(r: Column) -> Column:
                def of_name(v: Column) -> Column:
                    mine = F.filter(sources, lambda s: (s["var"] == v) & (s["no"] <= r["no"]))
                    since = F.array_max(F.transform(mine, lambda s: s["no"]))
                    cleaned = F.exists(
                        F.slice(lines, since, r["no"] - since + 1), lambda x: x.rlike(clean) & x.contains(F.concat(F.lit("$"), v))
                    )
                    open_flow = since.isNotNull() & r["text"].contains(F.concat(F.lit("$"), v)) & ~F.coalesce(cleaned, F.lit(False))
                    return F.when(open_flow, F.struct(v.alias("var"), since.alias("source_line"), r["no"].alias("sink_line"), r["text"].alias("text")))

                return F.array_compact(F.transform(names, of_name))

            return F.flatten(F.transform(sinks, of_line))

        return let(assigned, reach)

    rows = source.select("project", "path", F.explode(let(F.col("lines"), flows)).alias("f")).select("project", "path", "f.*")
    kinds = F.array_compact(
        F.array(*[F.when(F.col("text").contains(s), F.struct(F.lit(s).alias("sink"), F.lit(r).alias("risk"))) for s, r in SINKS.items()])
    )
    return rows.select("project", "path", "var", "source_line", "sink_line", F.inline(kinds))


def _any_contains(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def flow_risk(taint: DataFrame, races: DataFrame, asyncs: DataFrame) -> DataFrame:
    """Overall risk per file: injections and critical races first, then the number of others."""
    zero = F.lit(0)
    a = taint.select("path", F.when(F.col("risk").isin(INJECTIONS), 1).otherwise(0).alias("critical"), F.lit(1).alias("flows"), zero.alias("high"))
    risk = F.create_map(*[F.lit(x) for kv in RACE_RISK.items() for x in kv])[F.col("pattern_id")]
    b = races.select("path", F.when(risk == "CRITICAL", 1).otherwise(0).alias("critical"), zero.alias("flows"), F.when(risk == "HIGH", 1).otherwise(0).alias("high"))
    c = asyncs.select("path", zero.alias("critical"), zero.alias("flows"), F.lit(1).alias("high"))
    out = a.unionByName(b).unionByName(c).groupBy("path").agg(*[F.sum(x).alias(x) for x in ("critical", "flows", "high")])
    high = F.col("flows") - F.col("critical") + F.col("high")
    level = F.when(F.col("critical") > 0, "CRITICAL").when(high > 5, "HIGH").when(high > 0, "MEDIUM").otherwise("LOW")
    return out.select("path", "critical", high.alias("high"), level.alias("overall_risk"))


# --- text forms of the syntax-tree checks --------------------------------------------------

# Fixed values.
ESCAPES = r"esc_html|esc_attr|esc_url|esc_textarea|wp_kses|intval|absint|sanitize_text_field"


def missing_login_check(files: DataFrame) -> DataFrame:
    """Account pages that never ask whether the visitor is logged in."""
    path = F.col("path")
    return files.filter(
        path.contains("account") & ~path.contains("login.php") & ~path.contains("register.php") & ~F.col("content").rlike(r"is_user_logged_in\s*\(")
    ).select("project", "path", F.lit(1).alias("line_no"))


TREE_DETECTORS = [
    Detector("unescaped_output", lambda text, no, lines: text.rlike(r"\becho\b.*\$") & ~text.rlike(ESCAPES) & ~text.rlike(r"the_|get_header|get_footer"), ("php",)),
    Detector(
        "fetch_without_nonce",
        lambda text, no, lines: text.rlike(r"\bfetch\s*\(") & text.rlike(r"(?i)cart|checkout") & ~around(lines, no, 0, 3).rlike(r"X-WP-Nonce|\.nonce|_nonce"),
        ("javascript",),
    ),
]
LOOP = r"\b(foreach|for|while)\b.*\{"


def _braces(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"[^{]", "")) - F.length(F.regexp_replace(line, r"[^}]", ""))


def calls_in_loops(files: DataFrame, call: str = r"get_post_meta\s*\(", guard: str = r"update_meta_cache\s*\(|have_posts\s*\(|the_post\s*\(") -> DataFrame:
    """The first query call of every loop, in files that do not prime the cache.

    A call belongs to the outermost loop whose braces are still open at its line.
    """
    source = with_lines(files).filter(~F.col("content").rlike(guard) & F.col("content").rlike(call) & F.col("content").rlike(LOOP))

    def found(lines: Column) -> Column:
        def numbers(pattern: str) -> Column:
            return F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i + 1)))

        def with_deltas(deltas: Column) -> Column:
            def with_loops(loops: Column) -> Column:
                def owner(c: Column) -> Column:
                    def holds(at: Column) -> Column:
                        start = F.struct(F.lit(0).alias("level"), F.lit(1 << 20).alias("low"))

                        def step(acc: Column, delta: Column) -> Column:
                            level = acc["level"] + delta
                            return F.struct(level.alias("level"), F.least(acc["low"], level).alias("low"))

                        return F.aggregate(F.slice(deltas, at, c - at), start, step, lambda acc: acc["low"] > 0)

                    return F.array_min(F.filter(loops, lambda at: F.when(at < c, holds(at)).otherwise(False)))

                return F.transform(numbers(call), lambda c: F.struct(c.alias("line_no"), owner(c).alias("loop_line")))

            return let(numbers(LOOP), with_loops)

        return let(F.transform(lines, lambda x: _braces(x)), with_deltas)

    rows = source.select("project", "path", F.explode(let(F.col("lines"), found)).alias("h")).select("project", "path", "h.*")
    return rows.filter(F.col("loop_line").isNotNull()).groupBy("project", "path", "loop_line").agg(F.min("line_no").alias("line_no"))


# --- positions of matches that span lines --------------------------------------------------


def match_spans(text: Column, pattern: str) -> Column:
    """Start and text of every match, from the pieces between the matches (1-based)."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(found, lambda m, i: F.struct(F.length(F.element_at(pieces, i + 1)).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(1).alias("pos"), F.array().cast("array<struct<start:int,m:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["pos"] + p["gap"]
        return F.struct((at + F.length(p["m"])).alias("pos"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), p["m"].alias("m")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


# Empty error handlers by language.
EMPTY_HANDLERS = {
    "javascript": r"catch\s*\([^)]*\)\s*\{\s*\}",
    "typescript": r"catch\s*\([^)]*\)\s*\{\s*\}",
    "php": r"catch\s*\([^)]*\)\s*\{\s*\}",
    "python": r"(?m)except.*?:\s*(?:pass|\.\.\.)\s*$",
    "go": r"if\s+err\s*!=\s*nil\s*\{\s*\}",
}
DEBUG_CALLS = {
    "javascript": r"\bconsole\.(log|debug|info|warn)\s*\(",
    "typescript": r"\bconsole\.(log|debug|info|warn)\s*\(",
    "python": r"\bprint\s*\(",
    "php": r"\b(?:var_dump|print_r|echo\s+\$|error_log)\s*\(",
}
STYLE_LANGS = ["css", "scss", "less", "html", "sql"]


def by_language(expressions: dict[str, Column]) -> Column:
    out = None
    for lang, value in expressions.items():
        cond = F.col("lang") == lang
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def empty_handlers(files: DataFrame) -> DataFrame:
    """Empty error handlers with the line they start on."""
    spans = by_language({lang: match_spans(F.col("content"), p) for lang, p in EMPTY_HANDLERS.items()})
    rows = files.select("project", "path", "lang", "content", F.explode(spans).alias("s"))
    head = F.substring(F.col("content"), F.lit(1), F.col("s.start") - 1)
    return rows.select("project", "path", "lang", (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line_no"))


def line_runs(files: DataFrame, is_member: Callable[[Column], Column], min_length: int) -> DataFrame:
    """Runs of consecutive lines that pass the test: gaps and islands inside the file row.

    Each line becomes one letter, so a run is a match in the file's letter string and its
    position is the line number.
    """
    source = with_lines(files) if "lines" not in files.columns else files
    letters = F.array_join(F.transform("lines", lambda x: F.when(is_member(x), "c").otherwise("x")), "")
    spans = match_spans(letters, f"c{{{min_length},}}")
    return source.select("project", "path", "lang", F.explode(spans).alias("s")).select(
        "project", "path", "lang", F.col("s.start").alias("line_no"), F.length("s.m").alias("length")
    )


def commented_blocks(files: DataFrame, min_length: int = 5) -> DataFrame:
    return line_runs(files.filter(~F.col("lang").isin(STYLE_LANGS)), lambda x: x.rlike(r"^\s*(//|#)"), min_length)


def long_files(files: DataFrame, max_lines: int = 500) -> DataFrame:
    count = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.filter(~F.col("lang").isin(STYLE_LANGS[:4])).select("project", "path", "lang", count.alias("lines")).filter(F.col("lines") > max_lines)


# --- mining over the corpus ----------------------------------------------------------------


def language_files(files: DataFrame, patterns: dict[str, str], min_hits: int = 1) -> DataFrame:
    """Per language: number of files with at least ``min_hits`` matches, and five examples."""
    from siftmill.sources.sinks import top_per_key

    n = by_language({lang: F.regexp_count("content", F.lit(p)) for lang, p in patterns.items()})
    hit = files.select("lang", "path", n.alias("n")).filter(F.col("n") >= min_hits).select("lang", "path")
    totals = hit.groupBy("lang").agg(F.count("*").alias("occurrences"))
    names = top_per_key(hit, ["lang"], ["path"], 5).groupBy("lang").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return totals.join(names, "lang")


def unresolved_tags(files: DataFrame, min_occurrences: int = 3) -> DataFrame:
    """FIXME, HACK and XXX comments: occurrences and five example files per tag."""
    from siftmill.sources.sinks import top_per_key

    tags = F.regexp_extract_all("content", F.lit(r"(?i)(?://|#|/\*)\s*(TODO|FIXME|HACK|XXX)\b"), F.lit(1))
    seen = files.select("path", F.explode(tags).alias("t")).select("path", F.upper("t").alias("tag")).filter(F.col("tag") != "TODO")
    per_file = seen.groupBy("tag", "path").agg(F.count("*").alias("n"))
    totals = per_file.groupBy("tag").agg(F.sum("n").alias("occurrences")).filter(F.col("occurrences") >= min_occurrences)
    names = top_per_key(per_file, ["tag"], ["path"], 5).groupBy("tag").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return totals.join(names, "tag").withColumn("confidence", F.least(F.col("occurrences") / 20, F.lit(0.8)))


# Numbers that need no name.
SAFE_NUMBERS = [
    "0", "1", "2", "10", "100", "1000", "60", "24", "365", "1024",
    "200", "201", "204", "301", "302", "400", "401", "403", "404", "500",
]


def magic_numbers(files: DataFrame, min_files: int = 3) -> DataFrame:
    """Numbers of three or more digits that recur in enough files."""
    source = with_lines(files.filter(~F.col("lang").isin(STYLE_LANGS)))
    lines = F.filter("lines", lambda x: ~strip(x).rlike(r"^(//|#|/\*|\*)"))
    numbers = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(?<![.A-Za-z0-9_])([0-9]{2,})(?![A-Za-z0-9_])"), F.lit(1))))
    found = source.select("path", F.explode(F.array_distinct(numbers)).alias("number"))
    return found.filter((F.length("number") >= 3) & ~F.col("number").isin(SAFE_NUMBERS)).groupBy("number").agg(
        F.count("*").alias("files")
    ).filter(F.col("files") >= min_files)


FUNCTION_START = (
    r"^\s*(?:(?:public|private|protected|static|async|export)\s+)*"
    r"(?:function\s+[A-Za-z0-9_]+|def\s+[A-Za-z0-9_]+|[A-Za-z0-9_]+\s*\([^)]*\)\s*[:{])"
)


def long_functions(files: DataFrame, min_lines: int = 100) -> DataFrame:
    """Functions longer than ``min_lines``: from a start line to the line that closes its braces.

    A start replaces an open one. One fold over the lines of a file keeps the open start and its
    depth and records what it closes.
    """
    source = with_lines(files.filter(~F.col("lang").isin(STYLE_LANGS)))
    rows = F.transform("lines", lambda x, i: F.struct((i + 1).alias("no"), x.rlike(FUNCTION_START).alias("begins"), _braces(x).alias("delta")))
    state = F.struct(
        F.lit(None).cast("int").alias("start"), F.lit(0).alias("depth"), F.array().cast("array<struct<line_no:int,length:int>>").alias("out")
    )

    def step(acc: Column, r: Column) -> Column:
        start = F.when(r["begins"], r["no"]).otherwise(acc["start"])
        depth = F.when(r["begins"], r["delta"]).otherwise(acc["depth"] + r["delta"])
        closes = start.isNotNull() & (depth <= 0) & (r["no"] > start)
        long = closes & (r["no"] - start > min_lines)
        record = F.array(F.struct(start.alias("line_no"), (r["no"] - start).alias("length")))
        return F.struct(
            F.when(closes, F.lit(None).cast("int")).otherwise(start).alias("start"), depth.alias("depth"),
            F.when(long, F.concat(acc["out"], record)).otherwise(acc["out"]).alias("out"),
        )

    found = F.aggregate(rows, state, step, lambda acc: acc["out"])
    return source.select("project", "path", "lang", F.inline(found))


def repeated_blocks(files: DataFrame, size: int = 4, min_files: int = 3, min_chars: int = 40) -> DataFrame:
    """Blocks of consecutive lines found in several files: one row per block, counted by hash.

    Each file contributes a block once, so the count is of files; only hash, count and one
    sample travel through the shuffle.
    """
    source = with_lines(files)

    def blocks(lines: Column) -> Column:
        trimmed = F.transform(lines, lambda x: strip(x))

        def cut(t: Column) -> Column:
            n = F.size(t) - size + 1
            starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(t, i, size), "\n"))

        return let(trimmed, cut)

    good = F.filter(
        blocks(F.col("lines")), lambda b: (F.length(b) >= min_chars) & ~b.rlike(r"^(//|#|/\*|\*|import|from|use )")
    )
    found = source.select("path", F.explode(F.array_distinct(good)).alias("block"))
    return found.groupBy(F.md5("block").alias("block_hash")).agg(
        F.count("*").alias("files"), F.min("block").alias("block"), F.min("path").alias("first_path")
    ).filter(F.col("files") >= min_files)


# --- facts, names, inventory ---------------------------------------------------------------

# Style facts by key.
STYLE_FACTS = {
    "spacing_base": r"py-([0-9]+)\s+",
    "spacing_md": r"py-[0-9]+\s+md:py-([0-9]+)",
    "radius": r"rounded-([A-Za-z0-9_]+)",
    "container": r"max-w-([A-Za-z0-9_]+)",
    "shadow": r"shadow-([A-Za-z0-9_]+)",
    "grid_cols": r"(?:md:|lg:)?grid-cols-([0-9]+)",
}


def style_facts(files: DataFrame, patterns: dict[str, str] = STYLE_FACTS) -> DataFrame:
    """The most common value of each style key per file; the first in order wins a tie.

    Counting happens inside the file row: distinct values with their counts, then the maximum.
    """
    parts = []
    for key, pattern in patterns.items():
        values = F.filter(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda v: ~v.isin("", "none"))

        def best(vs: Column, key: str = key) -> Column:
            counted = F.transform(
                F.array_distinct(vs),
                lambda v: F.struct(F.size(F.filter(vs, lambda w: w == v)).alias("n"), (-F.array_position(vs, v)).alias("neg"), v.alias("value")),
            )
            top = F.array_max(counted)
            return F.struct(F.lit(key).alias("key"), top["value"].alias("value"), top["n"].alias("n"))

        parts.append(_let_filter(values, best))
    return files.select("project", "path", F.inline(F.array_compact(F.array(*parts))))


def _let_filter(values: Column, use) -> Column:
    """``use(values)`` when there are any, else null."""
    return F.get(F.transform(F.filter(F.array(values), lambda v: F.size(v) > 0), lambda v: use(v)), F.lit(0))


def api_facts(code: Column, project_prefix: str = "load_item") -> Column:
    """Calls, hooks, keys and checks a file uses, as a set of prefixed names.

    Comments are removed first, the whole text is read.
    """
    from siftmill.functions.text import clean_tokens, strip_comments

    def extract(text: Column) -> Column:
        def all_of(pattern: str, prefix: str = "", suffix: str = "") -> Column:
            return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(prefix), x, F.lit(suffix)))

        return F.concat(
            all_of(rf"\b({project_prefix}_[A-Za-z0-9_]+)\s*\("),
            all_of(r"\b(wp_[a-z][a-z0-9_]*)\s*\(", "wp:"),
            all_of(r"\b(is_[a-z][a-z0-9_]*|has_[a-z][a-z0-9_]*)\s*\(", "wp:"),
            all_of(r"(?:add_action|add_filter|do_action|apply_filters)\s*\(\s*'([A-Za-z0-9_]+)'", "hook:"),
            all_of(r"\$_(?:GET|POST)\['([A-Za-z0-9_]+)'\]", "$input['", "']"),
            all_of(r"\b([A-Z][A-Z0-9]*_[A-Z0-9_]+)\b", "const:"),
        )

    return F.array_sort(clean_tokens(let(strip_comments(code), extract)))


# How functions and classes are declared, by language.
FUNCTION_NAMES = {
    "python": [r"(?m)^\s*def\s+([a-zA-Z_][A-Za-z0-9_]*)\s*\("],
    "javascript": [r"function\s+([a-zA-Z_$][A-Za-z0-9_]*)", r"(?:const|let|var)\s+([a-zA-Z_$][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?\("],
    "typescript": [r"function\s+([a-zA-Z_$][A-Za-z0-9_]*)", r"(?:const|let|var)\s+([a-zA-Z_$][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?\("],
    "php": [r"function\s+([a-zA-Z_][A-Za-z0-9_]*)"],
    "go": [r"(?m)^func\s+(?:\([^)]+\)\s+)?([a-zA-Z_][A-Za-z0-9_]*)\s*\("],
    "rust": [r"(?m)^\s*(?:pub\s+)?fn\s+([a-zA-Z_][A-Za-z0-9_]*)\s*[<(]"],
    "ruby": [r"(?m)^\s*def\s+([a-zA-Z_][A-Za-z0-9_]*[?!]?)"],
}
CLASS_NAMES = {
    "python": [r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"],
    "javascript": [r"class\s+([A-Za-z_$][A-Za-z0-9_]*)"],
    "typescript": [r"(?:class|interface|type)\s+([A-Za-z_$][A-Za-z0-9_]*)"],
    "php": [r"(?:class|interface|trait)\s+([A-Za-z_][A-Za-z0-9_]*)"],
    "go": [r"(?m)^type\s+([A-Za-z_][A-Za-z0-9_]*)\s+struct"],
    "rust": [r"(?:pub\s+)?struct\s+([A-Za-z_][A-Za-z0-9_]*)"],
    "ruby": [r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"],
}


def declared_names(files: DataFrame, by_line: bool = False) -> DataFrame:
    """Names of functions and classes with their case class; per line when asked."""
    source = with_lines(files)
    parts = []
    for kind, patterns in (("function", FUNCTION_NAMES), ("class", CLASS_NAMES)):
        def names_in(text: Column, patterns: dict[str, list[str]] = patterns) -> Column:
            return by_language(
                {lang: F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ps]) for lang, ps in patterns.items()}
            )

        if by_line:
            found = F.flatten(
                F.transform("lines", lambda x, i: F.transform(F.coalesce(names_in(x), F.array().cast("array<string>")), lambda n: F.struct((i + 1).alias("line_no"), n.alias("name"))))
            )
        else:
            found = F.transform(names_in(F.col("content")), lambda n: F.struct(F.lit(0).alias("line_no"), n.alias("name")))
        rows = source.select("project", "path", "lang", F.inline(found)).withColumn("kind", F.lit(kind))
        parts.append(rows)
    out = parts[0].unionByName(parts[1]).filter((F.length("name") > 2) & ((F.col("kind") == "class") | ~F.col("name").startswith("__")))
    return out.withColumn("case_class", case_class(F.col("name")))


# Operations an inventory lists.
SECURITY_FUNCTIONS = [
    "wp_remote_post", "wp_remote_get", "wp_remote_request", "curl_exec", "file_get_contents", "fopen",
    "file_put_contents", "eval", "exec", "system", "shell_exec", "passthru", "unserialize", "base64_decode",
    "wp_verify_nonce", "check_ajax_referer", "check_admin_referer", "sanitize_text_field", "sanitize_email",
    "wp_kses", "wp_kses_post", "absint", "intval",
]
DB_FUNCTIONS = [
    "$wpdb->query", "$wpdb->get_results", "$wpdb->get_row", "$wpdb->get_var", "$wpdb->insert",
    "$wpdb->update", "$wpdb->delete", "$wpdb->prepare",
]
HOOK_FUNCTIONS = ["add_action", "add_filter", "do_action", "apply_filters", "remove_action", "remove_filter"]
ERROR_WORDS = ["try", "catch", "throw", "is_wp_error", "WP_Error", "error_log", "trigger_error"]
CLIENT_ERROR_WORDS = ["try", "catch", "throw"]
CLIENT_CALLS = {"fetch": r"\bfetch\s*\(", "axios": r"\baxios\.[a-z]+\s*\(", "$.ajax": r"\$\.ajax\s*\("}
NEARBY_HANDLING = (
    r"(?i)is_wp_error\s*\(|WP_Error|try\s*\{|catch\s*\(|if\s*\(\s*empty\s*\(|if\s*\(\s*!\s*"
    r"|if\s*\(\s*\$[a-zA-Z_].*===.*false|return\s+false|return\s+null|throw\s+new"
)


ITEMS = "array<struct<pattern_type: string, pattern_name: string, severity: string, context: string>>"


def inventory(files: DataFrame) -> DataFrame:
    """Declared names, calls, hooks and error handling of server and client code, by line."""
    source = with_lines(files).filter(F.col("lang").isin("php", "javascript", "typescript"))

    def fixed(text: Column, kind: str, severity: str, tests: list[tuple[str, Column]]) -> list[Column]:
        return [F.when(cond, _item(kind, F.lit(name), severity, text)) for name, cond in tests]

    # A regex is run on lines that hold its literal only: a search in bytes, where a regex decodes the line.
    def names(text: Column, kind: str, severity: str, pattern: str, words: list[str]) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: _item(kind, n, severity, text))
        return F.when(reduce(or_, [text.contains(w) for w in words]), found).otherwise(F.array().cast(ITEMS))

    def word(text: Column, w: str, pattern: str) -> Column:
        return text.contains(w) & text.rlike(pattern)

    def server(text: Column, nearby: Column) -> Column:
        security = []
        for fn in SECURITY_FUNCTIONS:
            cond = word(text, fn, rf"\b{fn}\s*\(")
            if fn.startswith("wp_remote_"):
                cond = cond & ~nearby
            if fn == "wp_verify_nonce":
                cond = cond & ~text.rlike(r"if\s*\(.*wp_verify_nonce")
            security.append((fn, cond))
        rows = fixed(text, "security_op", "CRITICAL", security)
        rows += fixed(text, "db_op", "HIGH", [(fn, text.contains(fn)) for fn in DB_FUNCTIONS])
        rows += fixed(text, "hook", "SUGGEST", [(fn, word(text, fn, rf"\b{fn}\s*\(")) for fn in HOOK_FUNCTIONS])
        rows += fixed(text, "error_handling", "HIGH", [(w, word(text, w, rf"\b{w}\b")) for w in ERROR_WORDS])
        return F.concat(
            names(text, "function_def", "SUGGEST", r"function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", ["function"]),
            names(text, "class_def", "SUGGEST", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)", ["class"]), F.array_compact(F.array(*rows)),
        )

    def client(text: Column) -> Column:
        rows = fixed(text, "function_call", "CRITICAL", [(n, word(text, n, p)) for n, p in CLIENT_CALLS.items()])
        rows += fixed(text, "error_handling", "HIGH", [(w, word(text, w, rf"\b{w}\b")) for w in CLIENT_ERROR_WORDS])
        return F.concat(
            names(text, "function_def", "SUGGEST", r"(?:function|const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*[=\(]", ["function", "const", "let", "var"]),
            names(text, "class_def", "SUGGEST", r"class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", ["class"]),
            names(text, "hook", "SUGGEST", r"\b(use[A-Z][a-zA-Z]*)\s*\(", ["use"]), F.array_compact(F.array(*rows)),
        )

    # Only remote calls look at their neighbourhood; it is judged inside the file row, so what
    # is exploded is a line and one flag.
    def numbered(lines: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            handled = F.when(x.rlike(r"\bwp_remote_"), around(lines, i + 1, 5, 5).rlike(NEARBY_HANDLING)).otherwise(False)
            return F.struct((i + 1).alias("line_no"), strip(x).alias("text"), handled.alias("handled"))

        return F.transform(lines, row)

    rows = source.select("project", "path", "lang", F.inline(let(F.col("lines"), numbered)))
    items = F.when(F.col("lang") == "php", server(F.col("text"), F.col("handled"))).otherwise(client(F.col("text")))
    return rows.select("project", "path", "lang", "line_no", F.inline(items))


def _item(kind: str, name: Column, severity: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("pattern_type"), name.alias("pattern_name"), F.lit(severity).alias("severity"), text.alias("context"))


# --- named code units and design facts -----------------------------------------------------


def unit_category(name: Column, code: Column) -> Column:
    return (
        F.when(name.contains("guard") | name.contains("is_active") | code.contains("function_exists"), "security")
        .when(name.contains("sanitize") | name.contains("escape"), "php-security")
        .when(name.contains("get_product") | name.contains("get_order"), "item-api")
        .when(name.contains("cache") | name.contains("transient"), "performance")
        .otherwise("utility")
    )


def code_units(files: DataFrame, pattern: str, max_length: int = 500) -> DataFrame:
    """Named units whose full text matches ``pattern`` (group 1 is the name), with their hash."""
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    rows = files.select("project", "path", F.explode(found).alias("code")).filter(F.length("code") <= max_length)
    name = F.regexp_extract("code", pattern, 1)
    return rows.select(
        "project", "path", name.alias("pattern_name"), F.substring(F.md5("code"), 1, 8).alias("code_hash"), unit_category(name, F.col("code")).alias("category")
    )


# --- rewrites ------------------------------------------------------------------------------


def replace_around(files: DataFrame, pattern: str, search: str, replacement: str, before: int = 3, behind: int = 3) -> DataFrame:
    """Preview of a replace rule around each hit: the block before and after the change."""
    source = with_lines(files)

    def blocks(lines: Column) -> Column:
        hits = F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i + 1)))

        def of_hit(no: Column) -> Column:
            old = around(lines, no, before, behind)
            return F.struct(no.alias("line_no"), old.alias("before"), F.regexp_replace(old, search, replacement).alias("after"))

        return F.transform(hits, of_hit)

    rows = source.select("project", "path", F.inline(let(F.col("lines"), blocks)))
    return rows.filter(F.col("before") != F.col("after"))


def wrap_lines(files: DataFrame, pattern: str, prefix: str, suffix: str) -> DataFrame:
    """Files with every matching line wrapped, its indent kept."""
    def wrapped(x: Column) -> Column:
        return F.concat(F.regexp_extract(x, r"^(\s*)", 1), F.lit(prefix), F.regexp_replace(x, r"^\s+", ""), F.lit(suffix))

    lines = F.transform("lines", lambda x: F.when(x.rlike(pattern), wrapped(x)).otherwise(x))
    return with_lines(files).withColumn("content", F.array_join(lines, "\n")).drop("lines")


def delete_lines(files: DataFrame, pattern: str) -> DataFrame:
    return with_lines(files).withColumn("content", F.array_join(F.filter("lines", lambda x: ~x.rlike(pattern)), "\n")).drop("lines")


def unresolved_after(files: DataFrame, rewritten: DataFrame, pattern: str) -> DataFrame:
    """Lines that still match after a rewrite that keeps line numbers: per file, hits before,
    hits left on the same lines."""
    def hits(df: DataFrame, name: str) -> DataFrame:
        lines = F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(pattern), i + 1)))
        return with_lines(df).select("project", "path", lines.alias(name))

    both = hits(files, "old").join(hits(rewritten, "new"), ["project", "path"])
    return both.filter(F.size("old") > 0).select(
        "project", "path", F.size("old").alias("hits"), F.size(F.array_intersect("old", "new")).alias("left")
    )


# --- sibling consistency -------------------------------------------------------------------


def sibling_violations(files: DataFrame, group_file: str, constraint: str) -> DataFrame:
    """Files that use a constraint which the nearest group file above them does not use.

    The folders above a file are exploded (a path is short) and joined with the group folders;
    the deepest match decides.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    groups = files.filter(F.col("path").rlike(group_file)).groupBy("project", folder.alias("folder")).agg(
        F.bool_or(F.col("content").rlike(constraint)).alias("uses")
    )
    source = with_lines(files)
    first = F.array_min(F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(constraint), i + 1))))
    members = source.withColumn("line_no", first).filter(F.col("line_no").isNotNull())
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    placed = members.select("project", "path", "line_no", F.explode(ups).alias("folder")).join(groups, ["project", "folder"])
    nearest = placed.groupBy("project", "path", "line_no").agg(F.max_by("uses", F.length("folder")).alias("uses"))
    return nearest.filter(~F.col("uses")).select("project", "path", "line_no")
