"""What a scan leaves behind: history row, violation rows, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def scan_rows(hits: DataFrame, files: DataFrame, patterns_checked: int) -> DataFrame:
    """One history row per project: files, rules and violations by severity.

    Hits and files are reduced to their own per-project sums and then united; no join.
    """
    sev = F.col("severity")
    zero = F.lit(0).cast("long")
    by_hit = hits.groupBy("project").agg(
        zero.alias("files_scanned"),
        F.count("*").alias("violations_total"),
        F.count_if(sev == "CRITICAL").alias("violations_critical"),
        F.count_if(sev == "HIGH").alias("violations_high"),
        F.count_if(sev == "SUGGEST").alias("violations_suggest"),
    )
    names = [c for c in by_hit.columns if c != "project"]
    by_file = files.groupBy("project").agg(F.count("*").alias("files_scanned"), *[zero.alias(c) for c in names[1:]])
    return (
        by_hit.unionByName(by_file)
        .groupBy("project")
        .agg(*[F.sum(c).alias(c) for c in names])
        .withColumn("patterns_checked", F.lit(patterns_checked))
    )


def violation_rows(hits: DataFrame, scan_id: int, detected_at: str) -> DataFrame:
    """Violations stamped with the scan and its time, ready to append."""
    ts = F.lit(detected_at).cast("timestamp")
    return hits.withColumn("scan_id", F.lit(scan_id).cast("long")).withColumn("detected_at", ts).withColumn(
        "scan_date", F.to_date("detected_at")
    )


def append_by_date(df: DataFrame, path: str) -> None:
    """Append to a table partitioned by scan date, so that look-back filters prune folders."""
    df.write.mode("append").partitionBy("scan_date").parquet(path)


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows per key. Spark limits each task's groups before the shuffle, so a hot
    key sends at most ``k`` rows per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def grouped_report(hits: DataFrame, max_per_rule: int) -> DataFrame:
    """Report rows by rule: exact count, how many are shown, how many the cap hides."""
    totals = hits.groupBy("rule_id").agg(F.count("*").alias("count"))
    shown = top_per_key(hits, ["rule_id"], ["path", "line_no"], max_per_rule)
    return shown.join(totals, "rule_id").select(
        "rule_id", "severity", "description", "count",
        F.least("count", F.lit(max_per_rule).cast("long")).alias("shown"),
        F.greatest(F.col("count") - max_per_rule, F.lit(0).cast("long")).alias("hidden_by_cap"),
        "rn", F.col("path").alias("file"), F.col("line_no").alias("line"), F.col("match_text").alias("match"),
    )


def report_json(hits: DataFrame, max_per_rule: int) -> DataFrame:
    """The grouped report as one JSON document per rule; groups are bounded by the cap."""
    rows = grouped_report(hits, max_per_rule)
    return rows.groupBy("rule_id").agg(
        F.to_json(
            F.struct(
                F.first("severity").alias("severity"), F.first("description").alias("description"),
                F.first("count").alias("count"), F.first("shown").alias("shown"),
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rn", "file", "line", "match"))),
                    lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"), s["match"].alias("match")),
                ).alias("files"),
            )
        ).alias("json")
    )


def write_report(hits: DataFrame, path: str) -> None:
    """The flat report: all violations as JSON lines, one folder per rule, nothing collected."""
    hits.write.mode("overwrite").partitionBy("rule_id").json(path)
