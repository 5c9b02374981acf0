"""Ranked lists, last-n calibration and quality trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.scores import action_label, ratio
from siftmill.sources.sinks import top_per_key


def component_detections(detections: DataFrame, min_confidence: float = 0.0, component_type: str | None = None,
                         accepted: bool | None = None, limit: int = 100) -> DataFrame:
    out = detections.filter(F.col("confidence") >= min_confidence)
    if component_type:
        out = out.filter(F.col("component_type") == component_type)
    if accepted is not None:
        out = out.filter(F.col("accepted") == accepted)
    return out.orderBy(F.desc("ts"), "gen_id", "line", "snippet", "confidence").limit(limit)


def pending_suggestions(suggestions: DataFrame, limit: int = 10) -> DataFrame:
    return suggestions.filter("status = 'pending'").orderBy(F.desc("times_seen"), "id", "project").limit(limit)


def promotable_patterns(patterns: DataFrame, min_seen: int = 3, limit: int = 10, per_run: int = 2) -> DataFrame:
    """The most seen open patterns; the first ``per_run`` are promoted in this run."""
    from pyspark.sql import Window as W

    order = [F.desc("times_seen"), F.col("id"), F.col("project")]
    top = patterns.filter(F.col("times_seen") >= min_seen).orderBy(*order).limit(limit)
    return top.withColumn("this_run", F.row_number().over(W.orderBy(*order)) <= per_run)


def score_calibration(scored: DataFrame, keys: list[str], newest: list, last: int = 200) -> DataFrame:
    """Accuracy, over- and under-confidence of the last scores with an outcome."""
    rows = top_per_key(scored.filter(F.col("outcome").isNotNull()), keys, newest, last)
    good, s = F.col("outcome") == "good", F.col("score_given")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if((s >= 70) == good).alias("right"),
        F.count_if((s >= 80) & ~good).alias("overconfident"), F.count_if((s < 50) & good).alias("underconfident"),
    )
    share = ratio(F.col("right"), F.col("total"))
    return out.select(
        *keys, "total", (share * 100).alias("accuracy"), "overconfident", "underconfident",
        F.when(share > 0.7, "good").otherwise("needs_adjustment").alias("calibration"),
    )


def adaptive_weights(scored: DataFrame, keys: list[str], newest: list, defaults: dict[str, float], last: int = 50,
                     min_rows: int = 5, limit_share: float = 0.3) -> DataFrame:
    """Weights per tool: times 0.85 when often overconfident, times 1.15 when underconfident."""
    stats = score_calibration(scored, keys, newest, last)
    over, under = (ratio(F.col(c), F.col("total")) for c in ("overconfident", "underconfident"))
    dims = F.array(*[F.struct(F.lit(k).alias("dimension"), F.lit(v).alias("w")) for k, v in defaults.items()])
    w = F.col("w")
    weight = F.when(F.col("total") < min_rows, w).when(over > limit_share, w * 0.85).when(under > limit_share, F.least(F.lit(1.0), w * 1.15)).otherwise(w)
    return stats.select("*", F.inline(dims)).select(*keys, "dimension", weight.alias("weight"))


def generation_quality(generations: DataFrame, margin_pct: int = 5) -> DataFrame:
    """Mean quality per project, and the trend of its recent half against the older half.

    The halves are split at the median position in time. The position is found from counts per
    (project, day) first, so that only the rows of the one day that holds the cut are ranked and
    a project with a third of all rows is never sorted in one task.
    """
    from pyspark.sql import Window as W

    key = F.struct("ts", "gen_id", "template")
    day = F.to_date("ts")
    gens = generations.withColumn("day", day)
    per_day = gens.groupBy("project", "day").agg(
        F.count("*").alias("n"), F.sum("quality_pct").alias("q"), F.sum("fix_count").alias("f"), F.sum("violations_at_gen").alias("v")
    )
    w = W.partitionBy("project").orderBy(F.desc("day"))
    whole = W.partitionBy("project")
    placed = per_day.withColumn("total", F.sum("n").over(whole)).withColumn("before", F.sum("n").over(w) - F.col("n"))
    placed = placed.withColumn("half", F.floor(F.col("total") / 2))
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.col("half") - F.col("before")))
    placed = placed.withColumn("take", take.cast("long"))
    cut = placed.filter((F.col("take") > 0) & (F.col("take") < F.col("n"))).select("project", "day", "take")
    # Rows of the cut day only, newest first; the first ``take`` belong to the recent half.
    inside = gens.join(cut, ["project", "day"]).withColumn(
        "rn", F.row_number().over(W.partitionBy("project", "day").orderBy(key.desc()))
    )
    part = inside.filter(F.col("rn") <= F.col("take")).groupBy("project").agg(F.sum("quality_pct").alias("cut_q"))
    full = F.col("take") == F.col("n")
    agg = placed.groupBy("project").agg(
        F.max("total").alias("total_files"), F.max("half").alias("half"), F.sum("q").alias("q"), F.sum("f").alias("fix_count"),
        F.sum("v").alias("violations_at_gen"), F.sum(F.when(full, F.col("q")).otherwise(0)).alias("full_q"),
    )
    out = agg.join(part, "project", "left").withColumn("recent_q", F.col("full_q") + F.coalesce("cut_q", F.lit(0).cast("long")))
    recent = ratio(F.col("recent_q"), F.col("half"))
    older = ratio(F.col("q") - F.col("recent_q"), F.col("total_files") - F.col("half"))
    trend = F.when(F.col("total_files") < 4, "stable").when(recent > older + margin_pct, "improving").when(recent < older - margin_pct, "degrading").otherwise("stable")
    return out.select(
        "project", "total_files", "fix_count", "violations_at_gen", (F.col("q") / F.col("total_files") / 100).alias("quality"), trend.alias("trend")
    )


def tag_score(tags: Column, keywords: list[str]) -> Column:
    """Five points per tag among the keywords, at most 15."""
    mine = F.array_distinct(F.transform(tags, lambda t: F.lower(t)))
    return F.least(F.size(F.array_intersect(mine, F.array(*[F.lit(k) for k in keywords]))) * 5, F.lit(15))


def ranked_rules(rules: DataFrame, history: DataFrame, confidence: DataFrame, categories: list[str], keywords: list[str],
                 signal: Column, limit: int, similarity: DataFrame | None = None) -> DataFrame:
    """Rules to follow, by a score from severity, category, tags, signals, history, confidence
    and (when given) similarity to the task."""
    sev = F.col("severity")
    out = rules.filter(sev.isin("CRITICAL", "HIGH")).join(history, "rule_id", "left").join(confidence, "rule_id", "left")
    score = (
        F.when(sev == "CRITICAL", 40).otherwise(20)
        + F.when(F.col("category").isin(categories), 25).otherwise(0)
        + tag_score(F.col("tags"), keywords)
        + F.when(signal, 30).otherwise(0)
        + F.coalesce(F.least(F.col("history") * 3, F.lit(15).cast("long")), F.lit(0).cast("long"))
        + F.coalesce(((F.col("confidence") - 0.5) * 20).cast("long"), F.lit(0).cast("long"))
    )
    if similarity is not None:
        out = out.join(similarity, "rule_id", "left")
        score = score + F.coalesce((F.col("similarity") * 20).cast("long"), F.lit(0).cast("long"))
    return out.select("rule_id", "severity", "category", score.alias("score")).orderBy(F.desc("score"), "rule_id").limit(limit)


def search_quality(results: DataFrame, group: str, keyword: str) -> DataFrame:
    """Relevance, coverage and their weighted score of a result set, and the score of a scan."""
    out = results.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.lower("description").contains(keyword)).alias("m"))
    relevance = F.least(F.lit(100).cast("long"), F.floor(ratio(F.col("m"), F.col("n")) * 100) + 20)
    coverage = F.least(F.lit(100).cast("long"), F.col("n") * 15)
    depth = F.when(F.col("n") == 0, 0).when(F.col("n") < 5, 60).otherwise(100)
    rules = F.least(F.lit(100).cast("long"), F.floor(F.col("n") / 4))
    whole = F.floor((relevance * 6 + coverage * 4) / 10)
    return out.select(
        group, relevance.alias("relevance"), coverage.alias("coverage"), (relevance * 0.6 + coverage * 0.4).cast("int").alias("score"),
        action_label(whole).alias("label"), (rules * 0.3 + F.lit(100) * 0.4 + depth * 0.3).cast("int").alias("scan_score"),
    )
