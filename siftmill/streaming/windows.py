"""Windowed counters over event streams. All aggregates combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, key: str, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a key by inactivity gap, with the calls by kind."""
    tool = F.col("event_type")
    out = events.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), F.col(key)).agg(
        F.count("*").alias("calls"), F.count_if(tool.isin("view", "click")).alias("reads"), F.count_if(tool.isin("purchase", "signup")).alias("writes")
    )
    return out.select(F.col(key), F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "calls", "reads", "writes")


def bucket_counts(events: DataFrame, key: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Usage per tumbling window and key."""
    cents = F.round(F.col("value") * 100).cast("long")
    out = events.withWatermark("event_time", late).groupBy(F.window("event_time", size).alias("w"), F.col(key)).agg(
        F.count("*").alias("ops"), F.sum(cents).alias("value_cents"), F.sum("k").alias("k_sum")
    )
    return out.select((F.unix_seconds("w.start") / 86400).cast("long").alias("day"), F.col(key), "ops", "value_cents", "k_sum")


def sliding_share(events: DataFrame, key: Column, failed: Column, size: str = "14 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Share of failed events per key over a sliding window."""
    out = events.withWatermark("event_time", late).groupBy(F.window("event_time", size, slide).alias("w"), key.alias("task")).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failed")
    )
    return out.select((F.unix_seconds("w.start") / 86400).cast("long").alias("first_day"), "task", "n", "failed", (F.col("failed") / F.col("n")).alias("share"))


def cache_hits(requests: DataFrame, cache: DataFrame, ttl_seconds: Column) -> DataFrame:
    """Stream-static join: requests answered by a cached decision that has not expired.

    ``cache`` has one row per key and is read anew for every batch.
    """
    age = F.unix_micros("event_time") - F.col("decided_us")
    return requests.join(cache, "user_id").filter((age >= 0) & (age <= ttl_seconds.cast("long") * 1_000_000))
