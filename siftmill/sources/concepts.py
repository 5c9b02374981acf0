"""The star-schema and event tables read as findings, scans, feedback, usage and sessions.

Each function states which columns stand for which concept; the SQL twins are in
``plans.concept_sql``. They are narrow projections, so filters and pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.sources.tables import table

CATEGORIES = ["php-security", "performance", "db-schema", "code-quality", "css-tokens", "seo"]
TASK_TYPES = ["checkout_page", "product_page", "fix_css", "generic"]
TOOL_OF_EVENT = {"view": "Read", "click": "Read", "purchase": "Write", "signup": "Edit", "error": "Bash"}


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def pct(value: Column) -> Column:
    """A fraction as whole hundredths."""
    return F.round(value * 100).cast("long")


def violations(spark: SparkSession, d: str) -> DataFrame:
    """lineitem: order is the scan, part the rule, supplier the file."""
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"), F.col("l_partkey").alias("rule_id"), F.col("l_suppkey").alias("file"),
        F.col("l_linenumber").alias("line"),
        F.when(flag == "A", "CRITICAL").when(flag == "N", "HIGH").otherwise("SUGGEST").alias("severity"),
        _pick(CATEGORIES, F.col("l_partkey")).alias("category"),
        F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_shipdate").alias("ts"),
    )


def scans(spark: SparkSession, d: str) -> DataFrame:
    """orders: customer is the project; violation counts are those of its line items."""
    counts = violations(spark, d).groupBy("scan_id").agg(
        F.count("*").alias("violations_total"), F.count_if(F.col("severity") == "CRITICAL").alias("violations_critical"),
        F.count_if(F.col("severity") == "HIGH").alias("violations_high"), F.count_if(F.col("severity") == "SUGGEST").alias("violations_suggest"),
        F.count_if(F.col("status") == "F").alias("violations_fixed"),
    )
    head = scan_heads(spark, d)
    names = [c for c in counts.columns if c != "scan_id"]
    zero = F.lit(0).cast("long")
    return head.join(counts, "scan_id", "left").select(*head.columns, *[F.coalesce(F.col(n), zero).alias(n) for n in names])


def scan_heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as feedback: A confirms, R is a false positive, N is silent; F fixed, O failed."""
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("rule_id"), F.when(flag == "A", "tp").when(flag == "R", "fp").alias("outcome"),
        (F.col("l_linestatus") == "F").alias("fixed"), F.col("l_shipdate").alias("ts"),
    )


def rule_severity(rule_id: Column) -> Column:
    return F.when(rule_id % 3 == 0, "CRITICAL").when(rule_id % 3 == 1, "HIGH").otherwise("SUGGEST")


def fixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("rule_id"), F.col("l_suppkey").alias("file"),
        _pick(["replace", "insert", "wrap"], F.col("l_linenumber")).alias("fix_type"),
        (F.col("l_linestatus") == "F").alias("verified"), (F.col("l_returnflag") == "R").alias("rolled_back"), F.col("l_shipdate").alias("ts"),
    )


def generations(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as generated files: quality is 1 - discount, fixes the line number."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("project"), F.col("l_suppkey").alias("template"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gen_id"),
        (100 - pct(F.col("l_discount"))).alias("quality_pct"), F.col("l_linenumber").cast("long").alias("fix_count"),
        F.col("l_quantity").cast("long").alias("violations_at_gen"), F.col("l_shipdate").alias("ts"),
    )


def detections(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as component detections: confidence 0.50 to 1.00 from the discount."""
    flag = F.col("l_returnflag")
    conf = 50 + 5 * pct(F.col("l_discount"))
    return table(spark, d, "lineitem").select(
        _pick(["header", "hero", "card", "button", "badge", "grid", "image"], F.col("l_suppkey")).alias("component_type"),
        conf.alias("confidence_pct"), (conf / 100).alias("confidence"),
        (F.col("l_linestatus") == "F").alias("auto_applied"),
        F.when(flag == "A", True).when((flag == "R") & (F.col("l_quantity") > 30), False).alias("accepted"),
        F.concat(F.lit("<div>"), F.col("l_quantity").cast("int").cast("string"), F.lit("</div>")).alias("snippet"),
        F.col("l_orderkey").alias("gen_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("ts"),
    )


def event_number() -> Column:
    """The ``k`` of the JSON properties."""
    return F.from_json("props", "k bigint")["k"]


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def usage(spark: SparkSession, d: str) -> DataFrame:
    """events as usage: views and clicks are handled locally (no remote tokens)."""
    k = event_number()
    local = F.col("event_type").isin("view", "click")
    cost = F.col("value").cast("decimal(18,4)")
    zero = F.lit(0).cast("long")
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("operation"), (k * 10).alias("tokens_local"),
        F.when(local, zero).otherwise(k * 5).alias("tokens_remote"),
        F.when(local, F.lit(0).cast("decimal(18,4)")).otherwise(cost).alias("cost_actual"),
        (cost * 2).cast("decimal(18,4)").alias("cost_baseline"), (k * 7).alias("latency_ms"), (k * 40 + 2500).alias("tokens_baseline"),
        (k * 90).alias("latency_baseline_ms"), k.alias("k"),
    )


def session_log(spark: SparkSession, d: str) -> DataFrame:
    """events as tool calls: a session is a user and a week, the file one of twelve."""
    k = event_number()
    week = F.floor(epoch_seconds(F.col("ts")) / 604800).cast("long")
    pairs = F.create_map(*[F.lit(x) for kv in TOOL_OF_EVENT.items() for x in kv])
    return table(spark, d, "events").select(
        "event_id", F.concat_ws("-", "user_id", week.cast("string")).alias("session_id"), "user_id", week.alias("week"), "ts",
        F.element_at(pairs, F.col("event_type")).alias("tool"), F.concat(F.lit("f"), k % 6, F.lit(".php")).alias("file_path"),
        _pick(TASK_TYPES, F.col("user_id")).alias("task_type"), k.alias("k"),
    )
