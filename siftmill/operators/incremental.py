"""Incremental work: changed files, reuse of earlier results, merges of old and new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FILE = ["project", "path"]  # what names a file; paths repeat between projects


def content_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content), 256)).drop(content)


def changed_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """Files whose (project, path, hash) the last snapshot does not hold: added or edited."""
    return new.join(old.select(*FILE, "sha256"), [*FILE, "sha256"], "left_anti")


def split_reusable(files: DataFrame, cache: DataFrame, rule_version: Column) -> tuple[DataFrame, DataFrame]:
    """(unchanged, to scan): a cached row counts when hash and rule version agree.

    ``cache`` holds one row per scanned file, also for files without violations, so a clean file
    is not scanned again.
    """
    valid = cache.filter(F.col("rule_version") == rule_version).select(*FILE, "sha256")
    keys = [*FILE, "sha256"]
    return files.join(valid, keys, "left_semi"), files.join(valid, keys, "left_anti")


def incremental_scan(files: DataFrame, cache: DataFrame, old_hits: DataFrame, rule_version: Column, scan) -> DataFrame:
    """Hits of all files: earlier hits of the unchanged ones, a fresh scan of the rest."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    same, todo = split_reusable(hashed, cache, rule_version)
    kept = old_hits.join(same.select(*FILE), FILE, "left_semi")
    fresh = scan(todo.drop("sha256"))
    return kept.select(*fresh.columns).unionByName(fresh)


def rule_set_version(rules: DataFrame, columns: list[str], buckets: int = 64) -> DataFrame:
    """One hash over the whole rule table, the same for any row order.

    Rows are hashed, sorted within hash buckets, and the bucket hashes are hashed again, so no
    group holds the whole table.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    bucket = F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % buckets
    inner = (
        rules.select(row.alias("h"))
        .withColumn("b", bucket)
        .groupBy("b")
        .agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("bh"))
    )
    return inner.agg(
        F.substring(
            F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("b", "bh"))), lambda s: s["bh"])), 256), 1, 16
        ).alias("rule_version")
    )


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(
        F.count("*").alias("total_entries"),
        F.countDistinct("rule_version").alias("versions"),
        F.max("scanned_at").alias("last_scan"),
    )


def evict_older(cache: DataFrame, cutoff: Column) -> DataFrame:
    return cache.filter(F.col("scanned_at") >= cutoff)


def new_suggestions(suggestions: DataFrame, existing: DataFrame) -> DataFrame:
    """Suggestions whose pattern and title are both unknown to the rule table."""
    patterns = existing.select(F.trim("pattern").alias("pattern")).filter("pattern != ''").distinct()
    titles = existing.select(F.lower(F.trim("title")).alias("title_key")).filter("title_key != ''").distinct()
    return (
        suggestions.withColumn("title_key", F.lower(F.trim("title")))
        .join(patterns, "pattern", "left_anti")
        .join(titles, "title_key", "left_anti")
        .drop("title_key")
    )


def upsert_suggestions(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (pattern, status): frequencies add up, the latest confidence and example win.

    Both sides hold ``(pattern, status, frequency, confidence, example, ts)``; one aggregate with
    map-side combine replaces the row-by-row upsert.
    """
    newest = F.max_by(F.struct("confidence", "example"), F.struct("ts", "example"))
    return (
        old.unionByName(new)
        .groupBy("pattern", "status")
        .agg(F.sum("frequency").alias("frequency"), newest.alias("latest"), F.max("ts").alias("ts"))
        .select("pattern", "status", "frequency", "latest.confidence", "latest.example", "ts")
    )


def promotion_outcome(
    candidates: DataFrame, approved: Column, min_approved: int = 50, min_confidence: float = 0.8, min_frequency: int = 3
) -> DataFrame:
    """Outcome of each pending candidate: the gate first, then confidence, then frequency."""
    outcome = (
        F.when(approved < min_approved, "skipped_gate")
        .when(F.coalesce("confidence", F.lit(0.0)) < min_confidence, "skipped_confidence")
        .when(F.coalesce("frequency", F.lit(1)) < min_frequency, "skipped_frequency")
        .otherwise("promoted")
    )
    return candidates.withColumn("outcome", outcome)


def merge_labelled(root: DataFrame, sub: DataFrame, label: str = "project") -> DataFrame:
    """Reports of the repository root and of all sub-projects as one, paths under their label."""
    path, name = F.col("path"), F.col(label).cast("string")
    shown = F.when(path.startswith("["), F.concat(F.lit("["), name, F.lit("] "), path)).otherwise(F.concat_ws("/", name, path))
    return root.unionByName(sub.withColumn("path", shown))
