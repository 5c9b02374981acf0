"""Aggregates over findings, scan history, feedback and usage.

Everything here is a sum, count, min, max or ``max_by`` with map-side combine, so a hot key
costs one partial row per task. Groups are never collected; samples are top-k per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.scores import demoted, ratio
from siftmill.functions.text import word_phrases
from siftmill.sources.sinks import top_per_key


def project_capabilities(files: DataFrame, markers: dict[str, Column]) -> DataFrame:
    """Capabilities of each project: the markers that any of its files shows."""
    flags = files.groupBy("project").agg(*[F.bool_or(cond).alias(name) for name, cond in markers.items()])
    caps = F.array_sort(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in markers])))
    return flags.select("project", caps.alias("capabilities")).filter(F.size("capabilities") > 0)


# --- findings ------------------------------------------------------------------------------


def severity_counts(hits: DataFrame, *keys: str) -> DataFrame:
    sev = F.col("severity")
    return hits.groupBy(*keys).agg(
        F.count_if(sev == "CRITICAL").alias("critical"),
        F.count_if(sev == "HIGH").alias("high"),
        F.count_if(sev == "SUGGEST").alias("suggest"),
        F.count("*").alias("total"),
    )


def rule_summary(hits: DataFrame, samples: int = 5) -> DataFrame:
    """Per rule: count, severity, number of files and the first ``samples`` file names."""
    per_file = hits.groupBy("rule_id", "severity", "file").agg(F.count("*").alias("n"))
    totals = per_file.groupBy("rule_id", "severity").agg(F.sum("n").alias("count"), F.count("*").alias("total_files"))
    shown = top_per_key(per_file, ["rule_id", "severity"], ["file"], samples)
    names = shown.groupBy("rule_id", "severity").agg(
        F.array_sort(F.collect_list("file")).alias("sample_files")
    )
    return totals.join(names, ["rule_id", "severity"])


def top_files(hits: DataFrame, n: int = 10) -> DataFrame:
    return hits.groupBy("file").agg(F.count("*").alias("violations")).orderBy(F.desc("violations"), "file").limit(n)


def rule_base_stats(rules: DataFrame) -> DataFrame:
    """Counts by severity, by category and by check type in one pass with grouping sets."""
    dims = ["severity", "category", "type"]
    sets = rules.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count("*").alias("rules"), F.grouping_id(*dims).alias("gid")
    )
    dim = F.when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "category").otherwise("type")
    return sets.select(dim.alias("dimension"), F.coalesce(*dims).alias("value"), "rules")


# --- scan history --------------------------------------------------------------------------


def violation_trend(scans: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Per project and day: violations by severity, fixed ones and number of scans."""
    recent = scans if cutoff is None else scans.filter(F.col("ts") >= cutoff)
    return recent.groupBy("project", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(
        *[F.sum(f"violations_{c}").alias(c) for c in ("critical", "high", "suggest", "total", "fixed")],
        F.count("*").alias("scans"),
    )


def project_summary(scans: DataFrame, fixes: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Per project: number of scans, fixes, live dismissals, and the latest scan.

    The three inputs are aggregated on their own and united, so no join multiplies rows.
    """
    zero = F.lit(0).cast("long")
    latest = F.max_by(
        F.struct("scan_id", "ts", "violations_critical", "violations_high", "violations_total"), F.struct("ts", "scan_id")
    )
    none = F.lit(None)
    a = scans.groupBy("project").agg(F.count("*").alias("total_scans"), zero.alias("total_fixes"), zero.alias("total_dismissed"), latest.alias("last"))
    last_type = a.schema["last"].dataType
    b = fixes.groupBy("project").agg(zero.alias("total_scans"), F.count("*").alias("total_fixes"), zero.alias("total_dismissed"), none.cast(last_type).alias("last"))
    c = dismissals.filter("active").groupBy("project").agg(zero.alias("total_scans"), zero.alias("total_fixes"), F.count("*").alias("total_dismissed"), none.cast(last_type).alias("last"))
    merged = a.unionByName(b).unionByName(c).groupBy("project").agg(
        F.sum("total_scans").alias("total_scans"), F.sum("total_fixes").alias("total_fixes"),
        F.sum("total_dismissed").alias("total_dismissed"), F.max("last").alias("last"),
    )
    return merged.select(
        "project", "total_scans", "total_fixes", "total_dismissed",
        F.date_format("last.ts", "yyyy-MM-dd").alias("last_date"), F.col("last.violations_critical").alias("last_critical"),
        F.col("last.violations_high").alias("last_high"), F.col("last.violations_total").alias("last_total"),
    )


RISK_ORDER = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def risk_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISK_ORDER]), level)


def high_impact_files(impacts: DataFrame, n: int = 10) -> DataFrame:
    """Files whose changes most often caused regressions. The highest risk is by rank, not by text."""
    out = impacts.filter("regressions > 0").groupBy("file").agg(
        F.count("*").alias("fix_count"), F.sum("regressions").alias("total_regressions"),
        F.max(risk_rank(F.col("risk_level"))).alias("rank"),
    )
    return out.orderBy(F.desc("total_regressions"), "file").limit(n).select(
        "file", "fix_count", "total_regressions",
        ratio(F.col("total_regressions"), F.col("fix_count")).alias("avg_regressions"),
        F.element_at(F.array(*[F.lit(r) for r in RISK_ORDER]), F.col("rank").cast("int")).alias("max_risk"),
    )


def impact_summary(impacts: DataFrame) -> DataFrame:
    return impacts.agg(
        F.count("*").alias("total_impacts"), F.sum("regressions").alias("total_regressions"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("high_risk_count"),
    ).withColumn("regression_rate", ratio(F.col("total_regressions"), F.col("total_impacts")) * 100)


# --- rule confidence -----------------------------------------------------------------------


def rule_state(feedback: DataFrame) -> DataFrame:
    """Counters per rule from feedback rows ``(rule_id, outcome, fixed, ts)``.

    ``outcome`` is 'tp', 'fp' or null; ``fixed`` is true, false or null.
    """
    return feedback.groupBy("rule_id").agg(
        F.count("*").alias("total_hits"),
        F.count_if(F.col("outcome") == "tp").alias("true_positives"),
        F.count_if(F.col("outcome") == "fp").alias("false_positives"),
        F.count_if(F.col("fixed")).alias("fix_success"),
        F.count_if(~F.col("fixed")).alias("fix_failure"),
        F.max("ts").alias("last_hit"),
    )


def confidence_of() -> Column:
    """0.7 (1 - false-positive rate) + 0.3 fix rate; without fixes the first term alone."""
    base = 1.0 - F.col("false_positives") / F.greatest("total_hits", F.lit(1).cast("long"))
    fixes = F.col("fix_success") + F.col("fix_failure")
    return F.when(fixes > 0, base * 0.7 + ratio(F.col("fix_success"), fixes) * 0.3).otherwise(base)


def with_confidence(state: DataFrame, severity: str = "severity") -> DataFrame:
    """Confidence and the severity it leaves: SUGGEST below 0.3, and for HIGH below 0.5."""
    out = state.withColumn("confidence", confidence_of())
    sev = F.col(severity)
    return out.withColumn(
        "effective_severity",
        F.when(F.col("confidence") < 0.3, "SUGGEST").when((F.col("confidence") < 0.5) & (sev == "HIGH"), "SUGGEST").otherwise(sev),
    )


def noisy_to_disable(state: DataFrame, threshold: float = 0.2, min_hits: int = 10) -> DataFrame:
    """Rules to switch off, with the reason in words."""
    fp = F.floor(ratio(F.col("false_positives"), F.col("total_hits")) * 100 + 0.5).cast("long")
    return state.filter((F.col("confidence") < threshold) & (F.col("total_hits") >= min_hits)).withColumn(
        "reason", F.concat(F.lit("FP rate "), fp, F.lit("%"))
    )


def noisiest(state: DataFrame, min_fps: int = 3, n: int = 20) -> DataFrame:
    return state.filter(F.col("false_positives") >= min_fps).orderBy("confidence", "rule_id").limit(n)


def merge_hits(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old counters and those of new hits as one state: a union and one aggregate, no join."""
    cols = ["total_hits", "true_positives", "false_positives", "fix_success", "fix_failure"]
    keep = ["rule_id", *cols, "last_hit"]
    return (
        state.select(*keep).unionByName(fresh.select(*keep)).groupBy("rule_id")
        .agg(*[F.sum(c).alias(c) for c in cols], F.max("last_hit").alias("last_hit"))
    )


def rule_metrics(state: DataFrame) -> DataFrame:
    """Precision, recall, fix rate, false-positive rate. Recall is true positives over all hits."""
    tp, fp, total = F.col("true_positives"), F.col("false_positives"), F.col("total_hits")
    fixes = F.col("fix_success") + F.col("fix_failure")
    return state.filter("total_hits > 0").select(
        "*", ratio(tp, tp + fp).alias("precision"), ratio(tp, total).alias("recall"),
        ratio(F.col("fix_success"), fixes).alias("fix_rate"), ratio(fp, total).alias("fp_rate"),
    )


def tuning_decision(metrics: DataFrame, severity: str = "effective_severity") -> DataFrame:
    """Disable below 0.50 precision; demote below 0.70 with more than 0.30 false positives."""
    sev = F.col(severity)
    demote = (F.col("precision") < 0.70) & (F.col("fp_rate") > 0.30)
    action = F.when(F.col("precision") < 0.50, "disable").when(demote & demoted(sev).isNotNull(), "demote").otherwise("none")
    return metrics.withColumn("action", action).withColumn("new_severity", F.when(F.col("action") == "demote", demoted(sev)))


def feedback_confidence(state: DataFrame) -> DataFrame:
    """+0.01 per approval, -0.02 per dismissal, within 0 and 1."""
    adjustment = (F.col("fix_success") - 2 * F.col("false_positives")) / 100
    return state.withColumn("adjustment", adjustment).withColumn(
        "new_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.col("adjustment")))
    )


# --- A/B tests and thresholds --------------------------------------------------------------


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts: 2tp / (2tp + fp + fn), 0 when there is nothing to count."""
    return ratio(2 * tp, 2 * tp + fp + fn)


def ab_metrics(results: DataFrame) -> DataFrame:
    """Metrics of both versions of each test in one row, from result rows per scan."""
    counts = ["true_positives", "false_positives", "false_negatives", "fix_success", "fix_failure"]
    aggs = []
    for v in ("baseline", "variant"):
        here = F.col("version") == v
        aggs.append(F.count_if(here).alias(f"{v}_scans"))
        aggs += [F.sum(F.when(here, F.col(c)).otherwise(0)).alias(f"{v}_{c}") for c in counts]
    out = results.groupBy("test_id").agg(*aggs)
    for v in ("baseline", "variant"):
        tp, fp, fn, ok, bad = (F.col(f"{v}_{c}") for c in counts)
        out = (
            out.withColumn(f"{v}_precision", ratio(tp, tp + fp)).withColumn(f"{v}_recall", ratio(tp, tp + fn))
            .withColumn(f"{v}_fix_rate", ratio(ok, ok + bad)).withColumn(f"{v}_f1", f1_of(tp, fp, fn))
        )
    return out


def ab_winner(metrics: DataFrame, target_scans: int) -> DataFrame:
    """Winner by F1 once both versions have enough scans; a difference below 0.05 is a tie."""
    ready = (F.col("baseline_scans") >= target_scans) & (F.col("variant_scans") >= target_scans)
    diff = F.abs(F.col("baseline_f1") - F.col("variant_f1"))
    tie = diff < 0.05
    winner = F.when(tie, "tie").when(F.col("variant_f1") > F.col("baseline_f1"), "variant").otherwise("baseline")
    sure = F.when(tie, 1.0 - diff / 0.05).otherwise(F.least(F.lit(1.0), diff / 0.2))
    return metrics.withColumn("winner", F.when(ready, winner)).withColumn("confidence", F.when(ready, sure).otherwise(0.0))


def confusion(detections: DataFrame, *keys: str) -> DataFrame:
    """Confusion counts of (applied, accepted); rows without feedback are left out."""
    app, acc = F.col("auto_applied"), F.col("accepted")
    out = detections.filter(acc.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("sample_size"), F.count_if(app & acc).alias("tp"), F.count_if(app & ~acc).alias("fp"),
        F.count_if(~app & acc).alias("fn"), F.count_if(~app & ~acc).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", f1_of(tp, fp, fn))


def best_threshold(scored: DataFrame, score: str, truth: str, thresholds: list[float], *keys: str,
                   default: float = 0.7, min_rows: int = 10) -> DataFrame:
    """Threshold of the best F1 per key; a tie keeps the lowest, no positive F1 the default.

    Each grid point is a pair of counters in one aggregate, so rows are not multiplied by the grid.
    """
    s, yes = F.col(score), F.col(truth)
    aggs = [F.count("*").alias("rows"), F.count_if(yes).alias("yes")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((s >= t) & yes).alias(f"tp{i}"), F.count_if((s >= t) & ~yes).alias(f"fp{i}")]
    out = scored.filter(yes.isNotNull()).groupBy(*keys).agg(*aggs)
    points = F.array(
        *[
            F.struct(
                f1_of(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col("yes") - F.col(f"tp{i}")).alias("f1"),
                F.lit(-t).alias("neg"), ratio(F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fp{i}")).alias("precision"),
                ratio(F.col(f"tp{i}"), F.col("yes")).alias("recall"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    best = F.array_max(points)
    enough = (F.col("rows") >= min_rows) & (best["f1"] > 0)
    return out.select(
        *keys, F.col("rows"), F.when(enough, -best["neg"]).otherwise(default).alias("threshold"),
        F.when(enough, best["f1"]).otherwise(0.0).alias("f1"), F.when(enough, best["precision"]).otherwise(0.0).alias("precision"),
        F.when(enough, best["recall"]).otherwise(0.0).alias("recall"),
    )


# --- feedback texts ------------------------------------------------------------------------


def dismiss_phrases(dismissals: DataFrame, min_occurrences: int = 5, examples: int = 3) -> DataFrame:
    """Phrases that recur in a rule's dismissal reasons, with up to three example files.

    Counts combine map-side; the examples are the smallest three file names, also kept by a
    bounded top-k, so a phrase found in a third of all reasons stays cheap.
    """
    said = dismissals.select("rule_id", "file", F.explode(word_phrases(F.col("reason"))).alias("phrase"))
    per_file = said.groupBy("rule_id", "phrase", "file").agg(F.count("*").alias("n"))
    totals = per_file.groupBy("rule_id", "phrase").agg(F.sum("n").alias("count"), F.count("*").alias("files")).filter(
        F.col("count") >= min_occurrences
    )
    shown = top_per_key(per_file.join(totals.select("rule_id", "phrase"), ["rule_id", "phrase"], "left_semi"),
                        ["rule_id", "phrase"], ["file"], examples)
    names = shown.groupBy("rule_id", "phrase").agg(F.array_sort(F.collect_list("file")).alias("example_files"))
    return totals.join(names, ["rule_id", "phrase"])


def rules_needing_tuning(phrases: DataFrame, dismissals: DataFrame, min_dismissals: int = 5) -> DataFrame:
    """Rules with enough dismissals, their top phrase and whether it dominates (80 %)."""
    totals = dismissals.groupBy("rule_id").agg(F.count("*").alias("dismissals")).filter(F.col("dismissals") >= min_dismissals)
    top = phrases.groupBy("rule_id").agg(F.max(F.struct(F.col("count"), F.col("phrase"))).alias("top"))
    return totals.join(top, "rule_id", "left").select(
        "rule_id", "dismissals", F.col("top.phrase").alias("phrase"), F.coalesce("top.count", F.lit(0).cast("long")).alias("count"),
        F.coalesce(ratio(F.col("top.count"), F.col("dismissals")) >= 0.8, F.lit(False)).alias("dominant"),
    )


def common_fp_tokens(dismissals: DataFrame, share: float = 0.5) -> DataFrame:
    """Tokens counted at least ``share`` times as often as the rule has dismissals."""
    from siftmill.functions.similarity import word_list

    totals = dismissals.groupBy("rule_id").agg(F.count("*").alias("dismissals"))
    tokens = dismissals.select("rule_id", F.explode(word_list(F.col("match_text"))).alias("token"))
    counts = tokens.groupBy("rule_id", "token").agg(F.count("*").alias("n"))
    return counts.join(totals, "rule_id").filter(F.col("n") >= F.col("dismissals") * share)


def pattern_accuracy(samples: DataFrame, patterns: dict[str, str], *keys: str) -> DataFrame:
    """Share of samples each pattern judges right: true findings matched, false ones not."""
    aggs = [
        F.count_if((F.col("is_fp") & ~F.col("text").rlike(p)) | (~F.col("is_fp") & F.col("text").rlike(p))).alias(f"n_{name}")
        for name, p in patterns.items()
    ]
    out = samples.groupBy(*keys).agg(F.count("*").alias("samples"), *aggs)
    return out.select(*keys, "samples", *[ratio(F.col(f"n_{n}"), F.col("samples")).alias(f"accuracy_{n}") for n in patterns])


def failure_analysis(failures: DataFrame, top: int = 5) -> DataFrame:
    """Per rule: its most frequent error kinds (first line of the message) and the totals."""
    kind = F.coalesce(F.when(F.col("message") != "", F.substring_index("message", "\n", 1)), F.lit("Unknown"))
    counts = failures.groupBy("rule_id", kind.alias("error_type")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("rule_id").agg(F.sum("n").alias("total_failures"))
    ranked = top_per_key(counts, ["rule_id"], [F.desc("n"), "error_type"], top)
    low = F.lower("error_type")
    return ranked.join(totals, "rule_id").select(
        "rule_id", "error_type", "n", "rn", "total_failures",
        ratio(F.col("total_failures"), F.col("total_failures") + 10).alias("failure_rate"),
        low.contains("syntax").alias("is_syntax"), low.contains("import").alias("is_import"), low.contains("type").alias("is_type"),
    )


def consensus(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Majority verdict by (count, confidence sum), its score, and whether a person is needed."""
    per = verdicts.groupBy(*keys, "verdict").agg(F.count("*").alias("n"), F.sum("confidence").alias("conf"))
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("agents"), F.max_by(F.struct("verdict", "n", "conf"), F.struct("n", "conf", "verdict")).alias("top")
    )
    score = (F.col("top.n") / F.col("agents")) * (F.col("top.conf").cast("double") / F.col("top.n"))
    return out.select(
        *keys, F.col("top.verdict").alias("consensus"), score.alias("confidence"), "agents",
        ((score < 0.7) | ((F.col("agents") > 1) & (F.col("top.n") == 1))).alias("needs_human"),
    )


def rollback_rates(fixes: DataFrame, min_rollbacks: int = 3, n: int = 20) -> DataFrame:
    out = fixes.groupBy("rule_id").agg(
        F.count_if("rolled_back").alias("rollbacks"), F.count("*").alias("fixes"), F.max(F.when(F.col("rolled_back"), F.col("ts"))).alias("last_rollback")
    )
    rate = ratio(F.col("rollbacks"), F.col("fixes"))
    return out.filter(F.col("rollbacks") >= min_rollbacks).withColumn("rollback_rate", rate).orderBy(
        F.desc("rollback_rate"), F.desc("rollbacks"), "rule_id"
    ).limit(n)


# --- usage ---------------------------------------------------------------------------------

USAGE_SUMS = ["cost_actual", "cost_baseline", "tokens_local", "tokens_baseline", "latency_ms", "latency_baseline_ms"]


def savings(usage: DataFrame, *keys: str | Column) -> DataFrame:
    """Operations, local share, costs and what was saved, by any keys. Costs are decimals."""
    out = usage.groupBy(*keys).agg(
        F.count("*").alias("ops"), F.count_if(F.col("tokens_remote") == 0).alias("local_ops"), *[F.sum(c).alias(c) for c in USAGE_SUMS]
    )
    saved = F.col("cost_baseline") - F.col("cost_actual")
    return out.withColumn("saved", saved).withColumn("local_rate", ratio(F.col("local_ops"), F.col("ops")) * 100).withColumn(
        "savings_pct", F.when(F.col("cost_baseline") > 0, saved.cast("double") / F.col("cost_baseline").cast("double") * 100).otherwise(0.0)
    )


# --- generated files, components -----------------------------------------------------------


def mined_components(detections: DataFrame, min_occurrences: int = 3, min_rate: float = 0.7) -> DataFrame:
    """Component types with enough accepted detections, and their most frequent snippet."""
    seen = detections.filter(F.col("confidence") >= 0.5)
    per_snippet = seen.groupBy("component_type", "snippet").agg(
        F.count("*").alias("n"), F.count("accepted").alias("judged"), F.count_if("accepted").alias("yes"), F.sum("confidence_pct").alias("conf")
    )
    out = per_snippet.groupBy("component_type").agg(
        F.sum("n").alias("occurrences"), F.sum("judged").alias("judged"), F.sum("yes").alias("yes"), F.sum("conf").alias("conf"),
        F.max(F.struct(F.col("n"), F.col("snippet"))).alias("top"),
    )
    rate = ratio(F.col("yes"), F.col("judged"))
    return out.filter((F.col("occurrences") >= min_occurrences) & (F.col("judged") > 0) & (rate >= min_rate)).select(
        "component_type", "occurrences", rate.alias("acceptance_rate"), (F.col("conf") / F.col("occurrences") / 100).alias("avg_confidence"),
        F.col("top.snippet").alias("example"), F.col("top.n").alias("example_count"),
        ((rate >= 0.8) & (F.col("occurrences") >= 5)).alias("add_to_templates"),
    )


def pattern_stats(detections: DataFrame) -> DataFrame:
    """Feedback statistics overall and per component type in one rollup."""
    return (
        detections.filter(F.col("accepted").isNotNull())
        .rollup("component_type")
        .agg(
            F.count("*").alias("detected"), F.count_if("auto_applied").alias("applied"), F.count_if("accepted").alias("accepted"),
            (F.sum("confidence_pct") / F.count("*")).alias("avg_confidence_pct"),
        )
        .withColumn("component_type", F.coalesce("component_type", F.lit("(all)")))
    )


def high_risk_templates(generations: DataFrame, n: int = 5) -> DataFrame:
    out = generations.filter(F.col("template").isNotNull()).groupBy("template").agg(
        F.sum("fix_count").alias("total_fixes"), F.sum("quality_pct").alias("q"), F.count("*").alias("generations")
    )
    return out.orderBy(F.desc("total_fixes"), "template").limit(n).select(
        "template", "total_fixes", (F.col("q") / F.col("generations")).alias("avg_quality_pct"), "generations"
    )


def learned_fix(fixes: DataFrame) -> DataFrame:
    """Per rule the most frequent fix that was verified and not rolled back; the latest breaks ties."""
    good = fixes.filter(F.col("verified") & ~F.col("rolled_back"))
    per = good.groupBy("rule_id", "fix_type").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    return per.groupBy("rule_id").agg(F.max(F.struct("n", "ts", "fix_type")).alias("top")).select(
        "rule_id", F.col("top.fix_type").alias("fix_type"), F.col("top.n").alias("applied_count")
    )


def cross_project_report(hits: DataFrame) -> DataFrame:
    """Violations by project, by platform and by category: one grouping-sets query."""
    dims = ["project", "platform", "category"]
    sets = hits.groupingSets([[F.col(d)] for d in dims], *dims).agg(F.count("*").alias("violations"), F.grouping_id(*dims).alias("gid"))
    name = F.when(F.col("gid") == 3, "project").when(F.col("gid") == 5, "platform").otherwise("category")
    return sets.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "violations").filter(F.col("value").isNotNull())


def golden_patterns(uses: DataFrame, min_usage: int = 3, promote_at: int = 5) -> DataFrame:
    """Patterns used often and never tied to a bug, with the projects using them counted."""
    out = uses.groupBy("pattern_type", "pattern_name").agg(
        F.count("*").alias("usage_count"), F.sum("bugs").alias("bug_count"), F.countDistinct("project").alias("projects")
    )
    return out.filter((F.col("usage_count") >= min_usage) & (F.col("bug_count") == 0)).withColumn(
        "auto_apply", F.col("usage_count") >= promote_at
    )


def clusters_by_pattern(hits: DataFrame, examples: int = 3) -> DataFrame:
    """Count, files and the first three examples of each detected pattern."""
    totals = hits.groupBy("pattern_id").agg(F.count("*").alias("count"), F.countDistinct("path").alias("files"))
    shown = top_per_key(hits, ["pattern_id"], ["path", "line_no"], examples)
    return shown.join(totals, "pattern_id").select("pattern_id", "count", "files", "rn", "path", "line_no", "line")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
