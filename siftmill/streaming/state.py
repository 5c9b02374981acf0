"""Keyed state over streams: debounced file changes, running rule counters and clamped trust."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounced(events: DataFrame, key: str, wait_ms: int = 500) -> DataFrame:
    """One event per key and burst: an event passes when the last passed one is at least
    ``wait_ms`` older. The state is that last time; rows of a batch are taken in time order."""

    def pass_events(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["time_us", "event_id"], kind="stable")
        keep = []
        for t in rows["time_us"].tolist():
            good = last is None or t - last >= wait_ms * 1000
            keep.append(good)
            last = t if good else last
        state.update((last,))
        yield rows[pd.Series(keep, index=rows.index)][[key, "event_id", "time_us", "content"]]

    rows = events.select(key, "event_id", F.unix_micros("event_time").alias("time_us"), F.col("props").alias("content"))
    return rows.groupBy(key).applyInPandasWithState(
        pass_events, f"{key} long, event_id long, time_us long, content string", "last long", "append", GroupStateTimeout.NoTimeout
    )


def file_status(changes: DataFrame, critical: Column, high: Column) -> DataFrame:
    """Rule check of a changed file: BLOCK on a critical finding, else PASS."""
    return changes.select("*", critical.cast("int").alias("critical"), high.cast("int").alias("high"), F.when(critical, "BLOCK").otherwise("PASS").alias("status"))


def running_counters(events: DataFrame, key: str, start: int = 50, low: int = 10, high: int = 95) -> DataFrame:
    """Hits, confirmations, dismissals and a clamped trust value per key, after every batch.

    Each update is a row with the number of events seen so far; the largest is the current
    state. ``delta`` holds the change of trust in hundredths.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, tp, fp, trust = state.get if state.exists else (0, 0, 0, start)
        rows = pd.concat(list(batches)).sort_values(["time_us", "event_id"], kind="stable")
        seen += len(rows)
        tp += int((rows["delta"] > 0).sum())
        fp += int((rows["delta"] < 0).sum())
        for d in rows["delta"].tolist():
            trust = min(high, max(low, trust + d))
        state.update((seen, tp, fp, trust))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "confirmed": [tp], "dismissed": [fp], "trust": [trust]})

    rows = events.select(key, "event_id", F.unix_micros("event_time").alias("time_us"), F.col("delta").cast("long").alias("delta"))
    return rows.groupBy(key).applyInPandasWithState(
        update, f"{key} long, seen long, confirmed long, dismissed long, trust long", "seen long, tp long, fp long, trust long", "append", GroupStateTimeout.NoTimeout
    )


def latest(updates: DataFrame, key: str) -> DataFrame:
    """The current state per key from the table of updates."""
    fields = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*fields), "seen").alias("s")).select(key, "s.*")
