"""Typed readers of the Parquet tables. Schemas are given, never inferred or merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


TABLE_DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters reach the Parquet scan."""
    return spark.read.schema(TABLE_DDL[name]).parquet(f"{sf_dir}/{name}.parquet")


# Tables a user keeps between runs. One schema per table; no evolution by ALTER.
RULE_DDL = (
    "rule_id string, severity string, category string, type string, description string, "
    "tags array<string>, platform string, pattern string, scope string, exclude string, "
    "exclude_path string, pre_check string, exclude_line string, scope_mode string, "
    "max_per_file int, dedup string, skip_empty_scope boolean, cross_check string, "
    "cross_check_scope string, ignore_matches array<string>, "
    "context_guard struct<pattern:string,lines_before:int,lines_after:int,cross_file:string>, "
    "requires array<string>, conflicts array<string>"
)

FILE_DDL = "project string, path string, ext string, lang string, content string"
VIOLATION_DDL = (
    "rule_id string, severity string, category string, description string, "
    "path string, line_no int, match_text string"
)
SCAN_DDL = (
    "scan_id bigint, path string, ts timestamp, platform string, severity string, mode string, "
    "violations_total bigint, violations_critical bigint, violations_high bigint, "
    "violations_suggest bigint, violations_fixed bigint, patterns_checked bigint, "
    "files_scanned bigint, duration_ms bigint"
)
