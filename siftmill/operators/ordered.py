"""Jobs that depend on order, written so that one hot key never lands in one task.

Three shapes cover them: the latest or the first few rows per key (``max_by`` or a bounded
row_number, both combined before the shuffle); an ordered fold whose steps compose (split by
time, then composed); and the previous row of a chain (split into buckets, then linked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.sources.sinks import top_per_key


def regressions(scans: DataFrame) -> DataFrame:
    """Severities whose count rose from the previous scan of a project to its latest."""
    last_two = top_per_key(
        scans.select("project", "scan_id", "ts", "violations_critical", "violations_high"), ["project"], [F.desc("ts"), F.desc("scan_id")], 2
    )
    now, before = F.col("rn") == 1, F.col("rn") == 2
    pairs = last_two.groupBy("project").agg(
        F.count("*").alias("n"),
        *[
            F.max(F.when(cond, F.col(f"violations_{s}"))).alias(f"{s}_{w}")
            for s in ("critical", "high") for w, cond in (("current", now), ("previous", before))
        ],
    ).filter("n = 2")
    rows = F.array(
        *[
            F.struct(F.lit(s.upper()).alias("severity"), F.col(f"{s}_previous").alias("previous"), F.col(f"{s}_current").alias("current"))
            for s in ("critical", "high")
        ]
    )
    return pairs.select("project", F.inline(rows)).filter(F.col("current") > F.col("previous")).withColumn(
        "delta", F.col("current") - F.col("previous")
    )


# --- decay ---------------------------------------------------------------------------------


def decayed(state: DataFrame, now: Column) -> DataFrame:
    """-10 % of the confidence per full 30 days without a hit; below 0.50 needs review."""
    days = F.coalesce(F.datediff(now, "last_hit"), F.lit(0))
    periods = F.greatest(F.floor(days / 30), F.lit(0))
    steps = F.when(periods > 0, F.sequence(F.lit(1), periods.cast("int"))).otherwise(F.array().cast("array<int>"))
    value = F.aggregate(steps, F.col("confidence"), lambda c, _: c - c * 0.1)
    return state.select(
        "*", days.alias("days_since_hit"), periods.cast("int").alias("decay_periods"), value.alias("new_confidence"),
        ((periods > 0) & (value < 0.5)).alias("needs_review"),
    )


def stale_rules(state: DataFrame, now: Column, threshold: float = 0.5) -> DataFrame:
    return state.filter(F.col("confidence") < threshold).withColumn("days_since_hit", F.datediff(now, "last_hit"))


def reset_decay(state: DataFrame, hits: DataFrame) -> DataFrame:
    """Last hit per rule after new hits: a union and a max, so a hot rule combines early."""
    fresh = hits.groupBy("rule_id").agg(F.max("ts").alias("last_hit"))
    return state.select("rule_id", "last_hit").unionByName(fresh).groupBy("rule_id").agg(F.max("last_hit").alias("last_hit"))


def decay_baselines(baselines: DataFrame, now: Column, after_days: int = 14, rate: float = 0.03, floor: float = 0.4) -> DataFrame:
    """Trust baselines not calibrated lately step towards the floor."""
    stale = (F.datediff(now, "last_calibrated") > after_days) & (F.col("trust") > floor)
    return baselines.withColumn("new_trust", F.when(stale, F.greatest(F.lit(floor), F.col("trust") - rate)).otherwise(F.col("trust")))


# --- clamped running value -----------------------------------------------------------------
# A step x -> min(hi, max(lo, x + d)) followed by another is again such a step, so a run of
# events folds to one (add, low, high) triple, and the triples of consecutive runs compose.


def _compose(a: Column, b: Column) -> Column:
    """The step that does ``a`` and then ``b``."""
    def bound(v: Column) -> Column:
        return F.least(b["high"], F.greatest(b["low"], v + b["add"]))

    return F.struct((a["add"] + b["add"]).alias("add"), bound(a["low"]).alias("low"), bound(a["high"]).alias("high"))


def _fold(steps: Column, low: int, high: int) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("add"), F.lit(-(2**40)).cast("long").alias("low"), F.lit(2**40).cast("long").alias("high"))
    return F.aggregate(steps, start, _compose)


def clamped_value(events: DataFrame, keys: list[str], order: list[str], delta: str, start: int, low: int, high: int,
                  buckets: list[Column]) -> DataFrame:
    """Final value per key of start + deltas, clamped to [low, high] after every event in order.

    ``buckets`` are expressions that split time ever coarser (say minute, hour, day); each level
    folds what it holds into one step, so no task sees more than one bucket of a key.
    Deltas are integers (hundredths, say), which keeps the result exact.
    """
    d = F.col(delta).cast("long")
    step = F.struct(d.alias("add"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))
    first = F.struct(*[F.col(o) for o in order])
    level = events.select(*keys, first.alias("at"), step.alias("step"), *[b.alias(f"b{i}") for i, b in enumerate(buckets)])
    level = level.withColumn("n", F.lit(1).cast("long"))
    for i in range(len(buckets) + 1):
        rest = [f"b{j}" for j in range(i, len(buckets))]
        run = F.transform(F.array_sort(F.collect_list(F.struct("at", "step"))), lambda s: s["step"])
        level = level.groupBy(*keys, *rest).agg(_fold(run, low, high).alias("step"), F.min("at").alias("at"), F.sum("n").alias("n"))
    value = F.least(F.col("step.high"), F.greatest(F.col("step.low"), F.lit(start) + F.col("step.add")))
    return level.select(*keys, value.alias("value"), F.col("n").alias("events"))


# --- last run of equal values --------------------------------------------------------------


def last_run(facts: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value per key and how many times in a row it was seen at the end.

    Two aggregates: the last value, then the last position holding another value; what follows
    it is the run. Both combine before the shuffle, no ordered window over a hot key.
    """
    at = F.struct(*order)
    latest = facts.groupBy(*keys).agg(F.max_by(value, at).alias("last_value"), F.max(at).alias("last_at"))
    joined = facts.select(*keys, F.col(value).alias("v"), at.alias("at")).join(latest, keys)
    breaks = joined.groupBy(*keys).agg(F.max(F.when(F.col("v") != F.col("last_value"), F.col("at"))).alias("break_at"))
    same = joined.filter(F.col("v") == F.col("last_value")).join(breaks, keys)
    run = same.filter(F.col("break_at").isNull() | (F.col("at") > F.col("break_at")))
    return run.groupBy(*keys, F.col("last_value").alias("value")).agg(F.count("*").alias("times_seen"), F.max("at").alias("last_seen"))


# --- retention -----------------------------------------------------------------------------


def newest_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """Keep the newest ``n`` rows per key (rank limited before the shuffle)."""
    return top_per_key(df, keys, order, n).drop("rn")


def retained(df: DataFrame, keys: list[str], order: list, per_key: int, total: int) -> DataFrame:
    """Newest ``per_key`` rows per key, then the newest ``total`` of all: a retention policy."""
    return newest_per_key(df, keys, order, per_key).orderBy(*order).limit(total)


# --- chains --------------------------------------------------------------------------------


def chain(df: DataFrame, keys: list[str], bucket: Column, order: list, row_id: str) -> DataFrame:
    """Each row with the id of the row before it in key order.

    ``bucket`` must rise with the order. Rows are linked inside (key, bucket); the first row of
    a bucket is linked to the last row of the bucket before it, found on the much smaller table
    of bucket ends. So a key with a third of all rows is spread over its buckets.
    """
    cut = df.withColumn("_b", bucket)
    w = W.partitionBy(*keys, "_b").orderBy(*order)
    inside = cut.withColumn("_prev", F.lag(row_id).over(w))
    place = F.struct(*order)
    ends = cut.groupBy(*keys, "_b").agg(F.max_by(row_id, place).alias("_last"))
    before = ends.select(*keys, "_b", F.lag("_last").over(W.partitionBy(*keys).orderBy("_b")).alias("_before"))
    return inside.join(before, [*keys, "_b"]).withColumn("previous", F.coalesce("_prev", "_before")).drop("_b", "_prev", "_before")


# --- small state rules ---------------------------------------------------------------------


def fixes_on_latest(generations: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Every fix of a file lowers the quality of its latest generation by 0.1, at least 0."""
    latest = generations.groupBy(*keys).agg(F.max_by(F.struct("gen_id", "quality_pct", "fix_count"), F.struct("ts", "gen_id")).alias("g"))
    n = fixes.groupBy(*keys).agg(F.count("*").alias("n"))
    out = latest.join(n, keys, "left")
    count = F.coalesce("n", F.lit(0).cast("long"))
    return out.select(
        *keys, F.col("g.gen_id").alias("gen_id"), (F.col("g.fix_count") + count).alias("fix_count"),
        F.greatest(F.lit(0).cast("long"), F.col("g.quality_pct") - 10 * count).alias("quality_pct"),
    )


def blessed(facts: DataFrame, min_seen: int = 10) -> DataFrame:
    """Facts of a known project seen often enough become conventions."""
    return facts.withColumn(
        "blessed", (F.col("times_seen") >= min_seen) & F.col("project").isNotNull() & ~F.col("project").isin("", "unknown")
    )


def quarantined(promoted: DataFrame, now: Column, days: int = 7, clean_scans: int = 5) -> DataFrame:
    """Still in quarantine until both the days and the clean scans are reached."""
    done = (now >= F.col("promoted_at") + F.make_dt_interval(F.lit(days))) & (F.coalesce("clean_scans", F.lit(0)) >= clean_scans)
    return promoted.withColumn("quarantined", ~done)


def rate_limited(patches: DataFrame, keys: list[str], now: Column, hours: int = 24) -> DataFrame:
    """Keys whose last patch is less than ``hours`` ago."""
    last = patches.groupBy(*keys).agg(F.max("ts").alias("last_patch"))
    return last.filter(F.col("last_patch") > now - F.make_dt_interval(F.lit(0), F.lit(hours)))
