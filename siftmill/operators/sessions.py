"""Session analytics: quality of a session, trust in it, and what sessions have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.scores import ratio
from siftmill.sources.sinks import top_per_key

WRITES = ["Write", "Edit"]
# Change of trust in hundredths by number of negative signals, and its limits.
TRUST_DELTA = [5, 0, -8, -15]
TRUST_START, TRUST_MIN, TRUST_MAX = 50, 10, 95
ATTEMPT_THRESHOLDS = {"skeleton": 0.3, "draft": 0.5, "ready": 0.7}


def _per_file(log: DataFrame, *keys: str) -> DataFrame:
    tool = F.col("tool")
    return log.groupBy(*keys, "file_path").agg(
        F.count("*").alias("calls"), F.count_if(tool == "Read").alias("reads"), F.count_if(tool.isin(WRITES)).alias("writes"),
        F.count_if(tool == "Edit").alias("edits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min(F.when(tool.isin(WRITES), F.col("ts"))).alias("first_write"), F.max(F.when(tool == "Bash", F.col("ts"))).alias("last_error"),
        F.max("k").alias("k"),
    )


def session_quality(log: DataFrame) -> DataFrame:
    """Files read more than once, files edited more than twice, and calls, per session."""
    return _per_file(log, "session_id", "task_type").groupBy("session_id", "task_type").agg(
        F.count_if(F.col("reads") > 1).alias("re_reads"), F.count_if(F.col("writes") > 2).alias("multi_edits"), F.sum("calls").alias("total_calls")
    )


def output_quality(log: DataFrame, briefed: list[str]) -> DataFrame:
    """Quality record of every session that wrote something."""
    files = _per_file(log, "session_id", "task_type", "week")
    in_brief = F.col("file_path").isin(briefed)
    out = files.groupBy("session_id", "task_type", "week").agg(
        F.sum(F.when(in_brief, F.col("reads")).otherwise(0)).alias("files_re_read"),
        F.greatest(F.max("edits") - 1, F.lit(0).cast("long")).alias("edits_after_first"),
        F.sum("calls").alias("total_calls"), F.sum("reads").alias("reads"), F.sum("writes").alias("writes"),
        F.timestamp_diff("SECOND", F.min("first_ts"), F.max("last_ts")).alias("duration_sec"), F.max("last_ts").alias("ended"), F.max("k").alias("trust_pct"),
    )
    tokens = F.col("total_calls") * 50 + F.col("reads") * 200 + F.col("writes") * 500
    return out.filter("writes > 0").withColumn("tokens", tokens)


def trust_signals(log: DataFrame, briefed: list[str]) -> DataFrame:
    """Negative signals of a session and the change of trust they cause (hundredths)."""
    files = _per_file(log, "session_id", "task_type")
    extra = (F.col("reads") > 0) & ~F.col("file_path").isin(briefed)
    out = files.groupBy("session_id", "task_type").agg(
        (F.count_if(extra) > max(len(briefed), 3)).alias("brief_insufficient"), (F.max("edits") > 2).alias("multiple_rewrites"),
        F.coalesce(F.max("last_error") > F.min("first_write"), F.lit(False)).alias("errors_after_write"), F.max("last_ts").alias("ended"),
    )
    signals = ["brief_insufficient", "multiple_rewrites", "errors_after_write"]
    n = sum((F.col(s).cast("int") for s in signals[1:]), F.col(signals[0]).cast("int"))
    return out.withColumn("negative", n).withColumn("delta", F.element_at(F.array(*[F.lit(x) for x in TRUST_DELTA]), n + 1))


def trust_baseline(quality: DataFrame, min_sessions: int = 3) -> DataFrame:
    """Trust per task type from mean re-reads and multi-edits, penalty at most 0.7."""
    out = quality.groupBy("task_type").agg(F.count("*").alias("sessions"), F.sum("re_reads").alias("r"), F.sum("multi_edits").alias("m"))
    n = F.col("sessions")
    penalty = F.least(F.col("r") / n * 0.08 + F.col("m") / n * 0.12, F.lit(0.7))
    return out.filter(n >= min_sessions).select("task_type", "sessions", F.greatest(1.0 - penalty, F.lit(0.3)).alias("trust"))


def weekly_dashboard(quality: DataFrame, *keys: str) -> DataFrame:
    n = F.count("*")
    return quality.groupBy(*keys).agg(
        n.alias("sessions"), (F.sum("tokens") / n).alias("avg_tokens"), (F.sum("files_re_read") / n).alias("avg_re_reads"),
        (F.sum("edits_after_first") / n).alias("avg_edits"), (F.sum("trust_pct") / n / 100).alias("avg_trust"), (F.sum("level_rank") / n).alias("avg_level"),
    )


def level_shares(quality: DataFrame, level: str = "level") -> DataFrame:
    """Sessions per output level and their share in percent."""
    from pyspark.sql import Window as W

    counts = quality.groupBy(level).agg(F.count("*").alias("sessions"))
    # One row per level here, so the unpartitioned total is over a handful of rows.
    total = F.sum("sessions").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("sessions") / total * 100)


def progress_score(weeks: DataFrame) -> DataFrame:
    """0 to 100 points from the first and the latest week of a dashboard."""
    row = F.struct("avg_tokens", "avg_re_reads", "avg_trust", "avg_level")
    ends = weeks.agg(F.count("*").alias("weeks"), F.min_by(row, "week").alias("first"), F.max_by(row, "week").alias("last"))

    def clamp(x: Column, top: float) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(top))

    f, t = (lambda c: F.col(f"first.{c}")), (lambda c: F.col(f"last.{c}"))
    tokens = F.when(f("avg_tokens") > 0, clamp((1 - t("avg_tokens") / f("avg_tokens")) * 100, 30.0)).otherwise(0.0)
    trust = F.least(t("avg_trust") * 30, F.lit(30.0))
    level = F.least(t("avg_level") / 3 * 20, F.lit(20.0))
    reads = F.when(f("avg_re_reads") > 0, clamp((1 - t("avg_re_reads") / f("avg_re_reads")) * 20, 20.0)).otherwise(20.0)
    return ends.select("weeks", F.when(F.col("weeks") >= 2, tokens + trust + level + reads).otherwise(0.0).alias("score"))


def stagnation(quality: DataFrame, this_week: int) -> DataFrame:
    """Compare the last two weeks with the two before; a row only when nothing improves."""
    recent, base = F.col("week").between(this_week - 1, this_week), F.col("week").between(this_week - 3, this_week - 2)
    sums = quality.filter(recent | base).agg(
        *[F.count_if(c).alias(f"n_{p}") for p, c in (("r", recent), ("b", base))],
        *[F.sum(F.when(c, F.col(m))).alias(f"{m}_{p}") for p, c in (("r", recent), ("b", base)) for m in ("tokens", "trust_pct", "level_rank")],
    )

    def mean(m: str, p: str) -> Column:
        return F.col(f"{m}_{p}") / F.col(f"n_{p}")

    out = sums.filter((F.col("n_r") > 0) & (F.col("n_b") > 0)).select(
        ((mean("tokens", "b") - mean("tokens", "r")) / F.greatest(mean("tokens", "b"), F.lit(1.0))).alias("token_improvement"),
        (mean("trust_pct", "r") / 100 - mean("trust_pct", "b") / 100).alias("trust_improvement"),
        (mean("level_rank", "r") - mean("level_rank", "b")).alias("level_improvement"),
        F.least((F.col("n_r") + F.col("n_b")) / 10, F.lit(1.0)).alias("confidence"),
    )
    flat = (F.col("token_improvement") < 0.05) & (F.col("trust_improvement") < 0.02) & (F.col("level_improvement") < 0.1)
    return out.withColumn("stagnating", flat & (F.col("confidence") >= 0.5))


# --- what sessions share -------------------------------------------------------------------


def reads_before_write(log: DataFrame) -> DataFrame:
    """Per session and written file: the reads that came before its first write.

    Reads are reduced to one row per (session, file, time) and written files to one row each,
    then joined on the session.
    """
    writes = log.filter(F.col("tool").isin(WRITES)).groupBy("session_id", F.col("file_path").alias("written")).agg(F.min("ts").alias("first_write"))
    reads = log.filter("tool = 'Read'").select("session_id", "file_path", "ts", "event_id")
    return writes.join(reads, "session_id").filter(F.col("ts") < F.col("first_write"))


def context_patterns(log: DataFrame) -> DataFrame:
    """One row per session: the files it read and wrote as JSON text, and when it ended.

    The file sets are sets of distinct names, built from one row per (session, file).
    """
    files = _per_file(log, "session_id", "task_type", "user_id")
    return files.groupBy("session_id", "task_type", "user_id").agg(
        F.to_json(F.array_sort(F.collect_set(F.when(F.col("reads") > 0, F.col("file_path"))))).alias("files_read"),
        F.to_json(F.array_sort(F.collect_set(F.when(F.col("writes") > 0, F.col("file_path"))))).alias("files_written"), F.max("last_ts").alias("ended"),
    )


def common_files(patterns: DataFrame, last: int = 20, min_sessions: int = 5, share: float = 0.6) -> DataFrame:
    """Files read in at least 60 % of the last sessions of a task type (three at least)."""
    totals = patterns.groupBy("task_type").agg(F.count("*").alias("sessions")).filter(F.col("sessions") >= min_sessions)
    rows = top_per_key(patterns.join(totals, "task_type"), ["task_type"], [F.desc("ended"), "session_id"], last)
    sampled = rows.groupBy("task_type").agg(F.count("*").alias("sampled"))
    reads = rows.select("task_type", "sessions", F.explode(F.from_json("files_read", "array<string>")).alias("file_path"))
    counts = reads.groupBy("task_type", "sessions", "file_path").agg(F.count("*").alias("seen")).join(sampled, "task_type")
    needed = F.greatest(F.lit(3), F.floor(F.col("sampled") * share))
    return counts.filter(F.col("seen") >= needed).select(
        "task_type", "file_path", "seen", "sampled", F.least(F.col("sessions") / 20, F.lit(1.0)).alias("confidence")
    )


def attempt_levels(outcomes: DataFrame) -> DataFrame:
    """Per task type and level: success rate and whether to attempt it (under three tries: yes)."""
    from siftmill.functions.scores import lookup

    out = outcomes.groupBy("task_type", "level").agg(F.count("*").alias("tries"), F.count_if("success").alias("good"))
    rate = ratio(F.col("good"), F.col("tries"))
    limit = lookup(ATTEMPT_THRESHOLDS, F.col("level"), F.lit(0.5))
    return out.select("task_type", "level", "tries", rate.alias("success_rate"), ((F.col("tries") < 3) | (rate >= limit)).alias("attempt"))


def suppressed_warnings(feedback: DataFrame, last: int = 10, threshold: float = 0.7) -> DataFrame:
    """Warning types judged useless in at least 70 % of their last ten judgements."""
    rows = top_per_key(feedback.filter(F.col("useful").isNotNull()), ["task_type", "warning"], [F.desc("ts"), "event_id"], last)
    out = rows.groupBy("task_type", "warning").agg(F.count("*").alias("n"), F.count_if(~F.col("useful")).alias("bad"))
    return out.filter((F.col("n") >= 3) & (ratio(F.col("bad"), F.col("n")) >= threshold)).select("task_type", "warning", "n", "bad")


def task_warnings(requests: DataFrame, patterns: DataFrame, signals: DataFrame, baselines: DataFrame, suppressed: DataFrame, now: Column) -> DataFrame:
    """Warnings for requested (task type, theme) pairs, minus the suppressed types."""
    seen = patterns.groupBy("task_type").agg(F.count("*").alias("task_sessions"))
    here = patterns.groupBy("task_type", "theme").agg(F.count("*").alias("theme_sessions"))
    recent = top_per_key(signals, ["task_type"], [F.desc("ended"), "session_id"], 10)
    bad = F.col("multiple_rewrites") | F.col("errors_after_write")
    failures = recent.groupBy("task_type").agg(F.count("*").alias("n"), F.count_if(bad).alias("failed"))
    out = requests.join(seen, "task_type", "left").join(here, ["task_type", "theme"], "left").join(failures, "task_type", "left").join(baselines, "task_type", "left")
    some = F.coalesce("task_sessions", F.lit(0).cast("long"))
    found = F.array_compact(
        F.array(
            F.when(some == 0, "novel_task"),
            F.when((some > 0) & (F.coalesce("theme_sessions", F.lit(0).cast("long")) < 3), "low_data"),
            F.when((F.col("n") >= 3) & (ratio(F.col("failed"), F.col("n")) > 0.4), "high_failure"),
            F.when(now > F.col("last_calibrated") + F.expr("INTERVAL 14 DAYS"), "stale_baseline"),
        )
    )
    rows = out.select("task_type", "theme", F.explode(found).alias("warning"))
    return rows.join(suppressed.select("task_type", "warning"), ["task_type", "warning"], "left_anti")


def transferable_pattern(patterns: DataFrame, min_rate: float = 0.7, min_success: int = 2) -> DataFrame:
    """Best pattern per task type by success rate; more successes, then the smaller id, win ties."""
    rate = ratio(F.col("success"), F.greatest(F.col("success") + F.col("failure"), F.lit(1).cast("long")))
    good = patterns.withColumn("rate", rate).filter((F.col("success") >= min_success) & (F.col("rate") >= min_rate))
    best = good.groupBy("task_type").agg(F.max_by(F.struct("pattern_id", "rate", "success"), F.struct("rate", "success", -F.col("pattern_id"))).alias("b"))
    return best.select("task_type", "b.pattern_id", F.col("b.rate").alias("confidence"), "b.success")


def cold_start(projects: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts for projects without any, taken from the projects of the same industry.

    The best fact per (industry, key) is the one seen most often; it is found once per industry
    and then given to every new project.
    """
    fresh = projects.join(facts.select("project").distinct(), "project", "left_anti")
    peers = facts.join(projects, "project").groupBy("industry", "key", "value").agg(F.max("times_seen").alias("times_seen"))
    best = peers.groupBy("industry", "key").agg(F.max(F.struct("times_seen", "value")).alias("b"))
    return fresh.join(best, "industry").select("project", "industry", "key", F.col("b.value").alias("value"), F.lit(1).alias("times_seen"))


def cold_start_trust(projects: DataFrame, used: DataFrame, trust: DataFrame, cap: float = 0.6) -> DataFrame:
    """Trust per (industry, task type) a new project starts with, at most ``cap``."""
    tasks = used.join(projects, "project").select("industry", "task_type").distinct()
    mean = trust.groupBy("task_type").agg((F.sum("trust_pct") / F.count("*") / 100).alias("mean"))
    return tasks.join(mean, "task_type").select("industry", "task_type", F.least("mean", F.lit(cap)).alias("trust"))


def novel_facts(session_facts: DataFrame, known: DataFrame, min_seen: int = 3) -> DataFrame:
    sure = known.filter(F.col("times_seen") >= min_seen).select("task_type", "binding").distinct()
    return session_facts.join(sure, ["task_type", "binding"], "left_anti")


def recommend_base(projects: DataFrame, per_industry: int = 5) -> DataFrame:
    """Base projects per industry by 0.7 match + 0.3 quality; the first is the choice."""
    ranked = top_per_key(projects, ["industry"], [F.desc("quality"), "generations", "project"], per_industry)
    return ranked.withColumn("score", F.lit(1.0) * 0.7 + F.col("quality") / 100.0 * 0.3).withColumn(
        "place", F.when(F.col("rn") == 1, "base").when(F.col("rn") <= 3, "alternative").otherwise("candidate")
    )


def health_snapshot(log: DataFrame, facts: DataFrame, now: Column, failures: Column | None = None, max_failures: int = 50) -> DataFrame:
    """State of the learning as (stat, value) rows: totals, recency and an overall status.

    Each input is reduced to one row and unpivoted; the rows are united, not joined.
    """
    per = log.groupBy("session_id").agg(F.max("ts").alias("ended"), F.min("ts").alias("started"), F.count_if(F.col("tool").isin(WRITES)).alias("writes"))
    week_ago = now - F.expr("INTERVAL 7 DAYS")
    one = per.agg(
        F.count("*").alias("total_sessions"), F.sum("writes").alias("total_writes"), F.count_if(F.col("started") > week_ago).alias("recent_sessions"),
        F.count_if((F.col("started") < week_ago) & (F.col("writes") == 0)).alias("stale_sessions"), F.max("ended").alias("last"),
    )
    failed = F.lit(0) if failures is None else failures
    status = F.when(failed > max_failures, "degraded").when((F.col("total_sessions") == 0) | (F.col("recent_sessions") == 0), "stalled").otherwise("healthy")
    counts = ["total_sessions", "total_writes", "recent_sessions", "stale_sessions"]
    sessions = one.select(*[F.col(c).cast("string").alias(c) for c in counts], F.date_format("last", "yyyy-MM-dd").alias("last_session"), status.alias("status"))
    learned = facts.agg(
        F.count("*").cast("string").alias("facts_learned"), F.count_if("blessed").cast("string").alias("blessed_conventions"), F.countDistinct("project").cast("string").alias("projects_learned")
    )

    def rows(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "stat", "value")

    return rows(sessions).unionByName(rows(learned))
