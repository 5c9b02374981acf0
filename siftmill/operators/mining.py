"""Mining recurring patterns, anomalies, coverage and fix candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.scores import ratio
from siftmill.functions.similarity import token_set
from siftmill.functions.text import category_of_match, escape_literal, negative_lookahead, severity_of_confidence
from siftmill.operators.editjoin import edit_links
from siftmill.operators.graph import components
from siftmill.operators.metrics import common_fp_tokens
from siftmill.session import cut_lineage

PROJECT_ROOTS = "themes|plugins"


def project_of_path(path: Column) -> Column:
    """The folder below the themes or plugins folder, null elsewhere."""
    found = F.regexp_extract(path, rf"(?:{PROJECT_ROOTS})/([^/]+)", 1)
    return F.when(found != "", found)


def platform_of_path(path: Column) -> Column:
    return F.when(path.contains(".php"), "wp").when(path.rlike(r"\.(tsx|jsx|ts|js)$"), "nextjs")


# --- coverage ------------------------------------------------------------------------------

# What a coverage gap is about.
GAP_APIS = ["wp_remote_post", "wp_remote_get", "wp_remote_request", "fetch", "axios", "$.ajax", "curl_exec", "file_get_contents"]
GAP_SECURITY = [
    "wp_verify_nonce", "check_ajax_referer", "sanitize_text_field", "esc_html", "esc_attr", "esc_url",
    "$_GET", "$_POST", "$_REQUEST", "$_SERVER",
]
GAP_DB = ["$wpdb->query", "$wpdb->get_results", "$wpdb->insert"]


def closest_rules(texts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(text, similarity, rule_id): for every distinct ``text`` that shares a token with a rule's pattern the rule of the
    greatest token Jaccard index, the first on a tie.

    An inverted index from token to rules: a text meets a rule once per shared token, so the work is that
    of the shared tokens and the plan is the same for any number of rules. The index holds the
    tokens of the rule table and is broadcast.
    """
    tokens = [(word, i, len(words)) for i, words in enumerate({*re.findall(r"\w+", pattern.lower())} for pattern in rules.values()) for word in sorted(words)]
    index = texts.sparkSession.createDataFrame(tokens, "token string, i int, size int")
    names = texts.sparkSession.createDataFrame(list(enumerate(rules)), "i int, rule_id string")
    held = texts.select("text", token_set(F.col("text")).alias("own")).select("text", F.size("own").alias("n"), F.explode("own").alias("token"))
    met = held.join(F.broadcast(index), "token").groupBy("text", "n", "i", "size").agg(F.count("*").alias("common"))
    similarity = F.col("common") / (F.col("n") + F.col("size") - F.col("common"))
    best = met.groupBy("text").agg(F.max(F.struct(similarity.alias("similarity"), (-F.col("i")).alias("less"))).alias("best"))
    best = best.select("text", "best.similarity", (-F.col("best.less")).alias("i"))
    return best.join(F.broadcast(names), "i").select("text", "similarity", "rule_id")


def rule_coverage(inventory: DataFrame, rules: dict[str, str], min_jaccard: float = 0.5) -> DataFrame:
    """Inventory items with how they are covered: a rule's regex first, else close tokens.

    Every distinct context is judged once, however often it occurs.
    """
    contexts = inventory.select(F.col("context").alias("text")).distinct()
    by_regex = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(rid)) for rid, p in rules.items()])
    judged = contexts.withColumn("_rx", by_regex)
    close = closest_rules(judged.filter("_rx is null"), rules).select("text", F.col("similarity").alias("_near"), F.col("rule_id").alias("_rule"))
    judged = judged.join(close, "text", "left").withColumnRenamed("text", "context")
    is_close = F.coalesce(F.col("_near") >= min_jaccard, F.lit(False))
    return inventory.join(judged, "context", "left").select(
        *inventory.columns,
        F.when(F.col("_rx").isNotNull(), "regex").when(is_close, "token").otherwise("none").alias("method"),
        F.coalesce("_rx", F.when(is_close, F.col("_rule"))).alias("rule_id"),
        F.when(F.col("_rx").isNotNull(), 1.0).otherwise(F.coalesce("_near", F.lit(0.0))).alias("similarity"),
    )


def file_coverage(covered: DataFrame) -> DataFrame:
    """Coverage per file: overall, by severity, and weighted 0.5 / 0.3 / 0.2."""
    yes = F.col("method") != "none"
    aggs = [F.count("*").alias("total"), F.count_if(yes).alias("covered")]
    weights = {"CRITICAL": 0.5, "HIGH": 0.3, "SUGGEST": 0.2}
    for s in weights:
        here = F.col("severity") == s
        aggs += [F.count_if(here).alias(f"{s.lower()}_total"), F.count_if(here & yes).alias(f"{s.lower()}_covered")]
    out = covered.groupBy("project", "path").agg(*aggs)
    parts = [ratio(F.col(f"{s.lower()}_covered"), F.col(f"{s.lower()}_total")) * w for s, w in weights.items()]
    return out.withColumn("percent", ratio(F.col("covered"), F.col("total")) * 100).withColumn("weighted", (parts[0] + parts[1] + parts[2]) * 100)


def project_coverage(files: DataFrame) -> DataFrame:
    p = F.col("percent")
    return files.groupBy("project").agg(
        F.count("*").alias("files"), F.sum("total").alias("total"), F.sum("covered").alias("covered"), F.count_if(p >= 100).alias("files_full"),
        F.count_if((p >= 80) & (p < 100)).alias("files_80"), F.count_if(p < 80).alias("files_below"),
    ).withColumn("percent", ratio(F.col("covered"), F.col("total")) * 100)


def coverage_gaps(covered: DataFrame) -> DataFrame:
    """Uncovered items with the kind of gap, its severity and the confidence that it is one."""
    name, kind = F.col("pattern_name"), F.col("pattern_type")

    def any_of(words: list[str], test) -> Column:
        cond = F.lit(False)
        for w in words:
            cond = cond | test(w)
        return cond

    gap = (
        F.when(any_of(GAP_APIS, lambda w: F.lower(name).contains(w.lower())), "uncovered_api")
        .when(any_of(GAP_SECURITY, name.startswith), "uncovered_security")
        .when(kind == "error_handling", "uncovered_error")
        .when(any_of(GAP_DB, name.contains), "uncovered_db")
        .otherwise("context_specific")
    )
    out = covered.filter("method = 'none'").withColumn("gap_type", gap)
    g, s = F.col("gap_type"), F.col("similarity")
    severity = F.when(g.isin("uncovered_api", "uncovered_security"), "CRITICAL").when(g.isin("uncovered_db", "uncovered_error"), "HIGH").otherwise(F.col("severity"))
    tenths = (
        F.lit(5) + F.when(g.isin("uncovered_api", "uncovered_security"), 3).otherwise(0)
        + F.when(s < 0.2, 2).when(s < 0.4, 1).otherwise(0) + F.when(kind.isin("security_op", "function_call"), 1).otherwise(0)
    )
    return out.withColumn("gap_severity", severity).withColumn("confidence", F.least(F.lit(10), tenths) / 10)


# --- recurring patterns --------------------------------------------------------------------


def category_of_cluster(text_flag, ext: Column) -> Column:
    """Category from what any text of a cluster holds; ``text_flag(regex)`` says whether one does."""
    php, css, js = ext == ".php", ext.isin(".css", ".scss"), ext.isin(".js", ".ts", ".jsx", ".tsx")
    return (
        F.when(php & text_flag(r"\$_GET|\$_POST|\$_REQUEST"), "php-security")
        .when(php & text_flag(r"(?i)sql|query"), "php-security")
        .when(css & text_flag(r"px|#"), "css-tokens")
        .when(js & text_flag(r"fetch|axios"), "js-contract")
        .when(js & text_flag(r"useState|useEffect"), "nextjs-react")
        .otherwise("code-quality")
    )


CLUSTER_TESTS = [r"\$_GET|\$_POST|\$_REQUEST", r"(?i)sql|query", r"px|#", r"fetch|axios", r"useState|useEffect"]


class Automaton:
    """The suffix automaton of a text: every state stands for the substrings that end at the same places.

    ``length`` is its longest substring, ``link`` the state of the longest proper suffix that ends
    elsewhere too, ``first`` where it ends for the first time. Linear in the text (Blumer et al., 1985).
    """

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for at, ch in enumerate(text):
            state = self._state({}, self.length[last] + 1, at)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = state
                p = self.link[p]
            if p < 0:
                self.link[state] = 0
            elif self.length[q := self.next[p][ch]] == self.length[p] + 1:
                self.link[state] = q
            else:
                copy = self._state(dict(self.next[q]), self.length[p] + 1, self.first[q])
                self.link[copy] = self.link[q]
                while p >= 0 and self.next[p].get(ch) == q:
                    self.next[p][ch] = copy
                    p = self.link[p]
                self.link[q] = self.link[state] = copy
            last = state
        self.by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)

    def _state(self, edges: dict[str, int], length: int, first: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def held(self, text: str) -> list[int]:
        """For every state the length of its longest substring that ``text`` holds, 0 for none. One walk over the text."""
        out = [0] * len(self.link)
        state = run = 0
        for ch in text:
            while state and ch not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if ch in self.next[state]:
                state, run = self.next[state][ch], run + 1
                if run > out[state]:
                    out[state] = run
        for v in self.by_length:  # a text that holds a substring holds its suffixes
            if out[v]:
                out[self.link[v]] = self.length[self.link[v]]
        out[0] = 0
        return out


def common_substring(members: DataFrame, keys: list[str]) -> DataFrame:
    """The longest run of characters that all texts of a cluster hold; on a tie the first in its shortest text.

    The substrings of the shortest text are the states of its automaton; every other text is one walk
    over it, so the work is linear in the texts. A cluster's run in a state is the least of its members,
    folded per batch before the shuffle, the same however they are split.
    """
    shortest = members.groupBy(*keys).agg(F.min_by("text", F.struct(F.length("text"), F.col("text"))).alias("_base"))
    schema = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in keys)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(keys, sort=False, dropna=False):
                states = Automaton(part["_base"].iat[0] or "")
                least = np.array(states.length)
                for text in part["text"]:
                    least = np.minimum(least, states.held(text or ""))
                rows = pd.DataFrame({"_place": np.arange(len(least)), "_end": states.first, "_run": least}, dtype="int64")
                yield rows.assign(**{k: part[k].iat[0] for k in keys})[[*keys, "_place", "_end", "_run"]]

    found = members.select(*keys, "text").join(shortest, keys).mapInPandas(runs, f"{schema}, _place bigint, _end bigint, _run bigint")
    least = found.groupBy(*keys, "_place", "_end").agg(F.min("_run").alias("_run"))
    best = least.groupBy(*keys).agg(F.max(F.struct("_run", (F.col("_run") - F.col("_end")).alias("_before"))).alias("_best"))
    start = (2 - F.col("_best._before")).cast("int")  # counted from 1
    return best.join(shortest, keys).select(*keys, F.when(F.col("_best._run") > 0, F.col("_base").substr(start, F.col("_best._run").cast("int"))).otherwise("").alias("text"))


def text_clusters(violations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Distinct violation texts of an extension grouped by similarity.

    Returns ``(ext, text, n, cluster)``; counting comes first, so a text found a billion times
    is one row in the comparison.
    """
    texts = violations.groupBy("ext", "text").agg(F.count("*").alias("n"))
    # Read three times below; the scan behind it runs once.
    texts = cut_lineage(texts.withColumn("id", F.xxhash64("ext", "text")))
    edges = edit_links(texts.select("ext", "id", "text"), ["ext"], threshold)
    comp = components(edges).select(F.col("node").alias("id"), "component")
    return texts.join(comp, "id", "left").select("ext", "text", "n", F.coalesce("component", "id").alias("cluster"))


def mined_patterns(violations: DataFrame, threshold: float = 0.8, min_occurrences: int = 2) -> DataFrame:
    """Suggested patterns: clusters with enough occurrences, their common text as a regex."""
    clusters = cut_lineage(text_clusters(violations, threshold))
    info = clusters.groupBy("ext", "cluster").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("texts"), F.min("text").alias("example"),
        *[F.bool_or(F.col("text").rlike(p)).alias(f"t{i}") for i, p in enumerate(CLUSTER_TESTS)],
    ).filter(F.col("occurrences") >= min_occurrences)
    flags = {p: F.col(f"t{i}") for i, p in enumerate(CLUSTER_TESTS)}
    category = category_of_cluster(lambda p: flags[p], F.col("ext"))
    shared = common_substring(clusters.join(info.select("ext", "cluster"), ["ext", "cluster"], "left_semi").select("ext", "cluster", "text"), ["ext", "cluster"])
    out = info.join(shared, ["ext", "cluster"]).filter((F.length("text") >= 5) | (F.col("texts") == 1))
    n = F.col("occurrences")
    word = "[a-zA-Z_][a-zA-Z0-9_]*"
    escaped = escape_literal(F.col("text"), None)
    pattern = F.when(F.col("texts") == 1, escaped).otherwise(F.concat(F.lit(f"{word}?"), escaped, F.lit(f"{word}?")))
    typed = out.withColumn("category", category)
    severity = F.when(F.col("category").contains("security"), "CRITICAL").when(n >= 10, "HIGH").otherwise("SUGGEST")
    return typed.select(
        "ext", "cluster", pattern.alias("pattern"), F.concat(F.lit("**/*"), "ext").alias("scope"), "category", severity.alias("severity"),
        n.alias("occurrences"), "texts", "example", F.least(F.lit(1.0), n / 10).alias("confidence"),
    )


def mined_across_projects(violations: DataFrame, patterns: DataFrame, clusters: DataFrame, min_projects: int = 2) -> DataFrame:
    """Patterns found in several projects; more than one platform makes them universal."""
    placed = violations.select("ext", "text", "project", "platform").distinct().join(clusters.select("ext", "text", "cluster"), ["ext", "text"])
    spread = placed.groupBy("ext", "cluster").agg(F.countDistinct("project").alias("projects"), F.countDistinct("platform").alias("platforms"))
    out = patterns.join(spread, ["ext", "cluster"]).filter(F.col("projects") >= min_projects)
    factor = F.when(F.col("platforms") > 1, 1.5).otherwise(1.2)
    return out.withColumn("universal", F.col("platforms") > 1).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") * factor))


def anomalies(violations: DataFrame, rules: dict[str, str], min_count: int = 3, max_similarity: float = 0.3, min_confidence: float = 0.5) -> DataFrame:
    """Texts seen often that no rule resembles, with confidence min(1, n/10) * (1 - similarity)."""
    counts = violations.filter("text != ''").groupBy("text").agg(
        F.count("*").alias("occurrences"), F.countDistinct("path").alias("files"), F.min("path").alias("example_path")
    ).filter(F.col("occurrences") >= min_count)
    near = closest_rules(counts.select("text"), rules).select("text", F.col("similarity").alias("near"))
    scored = counts.join(near, "text", "left").withColumn("similarity", F.coalesce("near", F.lit(0.0))).drop("near").filter(F.col("similarity") < max_similarity)
    conf = F.least(F.lit(1.0), F.col("occurrences") / 10) * (1 - F.col("similarity"))
    out = scored.withColumn("confidence", conf).filter(F.col("confidence") >= min_confidence)
    return out.withColumn("category", category_of_match(F.col("text"))).withColumn("severity", severity_of_confidence(F.col("confidence"), F.col("occurrences")))


# --- refinement and fixes ------------------------------------------------------------------


def refined_patterns(feedback: DataFrame, rules: DataFrame, fp_threshold: float = 0.3, min_fps: int = 3, gain: float = 0.1) -> DataFrame:
    """Noisy rules with a look-ahead against the tokens their false positives share, kept when
    accuracy on the history rises by more than ``gain``.

    ``feedback`` is ``(rule_id, match_text, is_fp)``, ``rules`` is ``(rule_id, pattern)``. Tokens
    shared by half of the false positives are few, so the set per rule is small. The noisy rules are
    broadcast: a join by rule would send all texts of a frequent rule to one task.
    """
    state = feedback.groupBy("rule_id").agg(F.count("*").alias("total"), F.count_if("is_fp").alias("fps"))
    noisy = state.filter((F.col("fps") / F.col("total") >= fp_threshold) & (F.col("fps") >= min_fps))
    wrong = feedback.filter("is_fp").join(F.broadcast(noisy.select("rule_id")), "rule_id", "left_semi")
    tokens = common_fp_tokens(wrong).groupBy("rule_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    built = noisy.join(tokens, "rule_id").join(rules, "rule_id").withColumn("refined", negative_lookahead(F.col("pattern"), F.col("tokens")))
    judged = feedback.join(F.broadcast(built.select("rule_id", "refined")), "rule_id").groupBy("rule_id").agg(
        F.count_if(F.col("is_fp") != F.expr("rlike(match_text, refined)")).alias("right"), F.count("*").alias("n")
    )
    before = 1 - F.col("fps") / F.col("total")
    out = built.join(judged, "rule_id").withColumn("accuracy_before", before).withColumn("accuracy_after", ratio(F.col("right"), F.col("n")))
    return out.withColumn("kept", F.col("accuracy_after") > F.col("accuracy_before") + gain).select(
        "rule_id", "pattern", "refined", F.size("tokens").alias("tokens"), "accuracy_before", "accuracy_after", "kept"
    )


# Code that a regex can describe.
REGEX_ABLE = (
    r"(?i)\$_GET|\$_POST|\$_REQUEST|\$_COOKIE|echo\s+\$|mysql_|eval\s*\(|base64_decode|<\?php|innerHTML\s*="
    r"|document\.write|SELECT.*FROM|INSERT.*INTO|UPDATE.*SET"
)


def fix_candidates(edits: DataFrame, rules: list[str], min_confidence: float = 0.5, frequent: int = 3) -> DataFrame:
    """Rule candidates from before and after texts: ``(path, ext, before_lines, after_lines)``.

    Confidence adds 0.3 for code a regex can describe, 0.2 when the removed text recurs, 0.3
    for a fix of reasonable size and 0.2 when no rule matches it yet.
    """
    bad, good = F.array_except("before_lines", "after_lines"), F.array_except("after_lines", "before_lines")
    out = edits.withColumn("bad", bad).withColumn("good", good)
    joined, fixed = F.trim(F.array_join("bad", "\n")), F.trim(F.array_join("good", "\n"))
    out = out.filter((F.size("bad") > 0) & (F.size("good") > 0)).withColumn("bad_code", joined).withColumn("good_code", fixed)
    out = out.filter((F.length("bad_code") >= 5) & (F.length("good_code") >= 5))
    out = out.withColumn("first_bad", F.trim(F.col("bad")[0])).withColumn("head", F.substring("bad_code", 1, 30))
    seen = out.groupBy("head").agg(F.count("*").alias("seen"))
    meaningful = F.size(F.filter("good", lambda x: F.trim(x) != "")) > 0
    conflict = F.lit(False)
    for p in rules:
        conflict = conflict | F.col("bad_code").rlike(p)
    tenths = (
        F.when(F.col("bad_code").rlike(REGEX_ABLE), 3).otherwise(0) + F.when(F.col("seen") >= frequent, 2).otherwise(0)
        + F.when(meaningful & (F.size("good") <= F.size("bad") * 3), 3).otherwise(0) + F.when(conflict, 0).otherwise(2)
    )
    low = F.lower(F.col("first_bad"))
    category = (
        F.when(low.rlike(r"\$_get|\$_post|\$_request|eval\(|base64_decode"), "security").when(low.rlike("select |insert |update |delete "), "security")
        .when(low.rlike(r"echo \$|print \$|innerhtml"), "security").when(low.rlike("mysql_|deprecated"), "deprecated")
        .when(F.col("ext").isin(".css", ".scss"), "css").when(F.col("ext").isin(".js", ".ts"), "javascript").otherwise("general")
    )
    scored = out.join(seen, "head").withColumn("confidence", tenths / 10).filter(F.col("confidence") >= min_confidence).withColumn("category", category)
    return scored.select(
        "path", escape_literal(F.col("first_bad")).alias("pattern"), F.concat(F.lit("**/*"), "ext").alias("scope"), "category",
        F.when(F.col("category") == "security", "HIGH").otherwise("SUGGEST").alias("severity"), "confidence", "bad_code", "good_code",
    )


def fix_type(diff: Column) -> Column:
    """What kind of hardening a fix is, from its text."""
    return (
        F.when(diff.rlike("wp_verify_nonce|check_ajax_referer"), "add_nonce_check")
        .when(diff.rlike("sanitize_text_field|esc_html|esc_attr|esc_url|wp_unslash"), "add_sanitization")
        .when(diff.contains("is_wp_error"), "add_error_handling")
        .when(diff.rlike("BEGIN|COMMIT"), "add_transaction")
        .when(diff.contains("try") & diff.contains("catch"), "add_try_catch")
    )


def context_of_name(name: Column) -> Column:
    """The role of a function or class from its name."""
    return (
        F.when(name.rlike("^handle_.*_ajax"), "ajax_handler").when(name.rlike("^process_.*_form"), "form_handler")
        .when(name.rlike("^save_.*"), "save_handler").when(name.rlike("^delete_.*"), "delete_handler")
        .when(name.contains("Controller"), "controller").when(name.contains("Service"), "service")
        .when(name.contains("Repository"), "repository").otherwise("generic")
    )


def contextual_lessons(names: DataFrame, fixes: DataFrame) -> DataFrame:
    """How often a kind of fix went with a kind of context, and in how many files."""
    typed = fixes.select("path", fix_type(F.col("diff")).alias("fix_type")).filter(F.col("fix_type").isNotNull())
    context = names.select("path", context_of_name(F.col("name")).alias("context")).distinct()
    return context.join(typed, "path").groupBy("context", "fix_type").agg(F.count("*").alias("lessons"), F.countDistinct("path").alias("files"))


def finding_confidence(findings: DataFrame, similar_rule: Column, large_file: int = 500) -> DataFrame:
    """Confidence of a suggestion: frequency, plus a known similar rule, minus a large file."""
    base = F.least(50 + F.col("n") * 10, F.lit(90)) / 100
    value = base + F.when(similar_rule, 0.1).otherwise(0.0) - F.when(F.col("lines") > large_file, 0.2).otherwise(0.0)
    return findings.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))

