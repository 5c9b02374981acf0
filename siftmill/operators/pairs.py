"""Relations between findings: co-occurrence, related rules, conflicts, ordering edges.

No job here emits all pairs of a group. Co-occurrence uses a prefix filter, edit conflicts are
counted from position histograms, ordering edges go through one node per file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.functions.scores import ratio

CHUNK = 50_000
HOT = 64  # findings at a location beyond which it is left out of the join where it may be


def symmetric(relations: DataFrame) -> DataFrame:
    """Relations in both directions, without repeats."""
    a = relations.select("rule_a", "rule_b")
    return a.unionByName(a.select(F.col("rule_b").alias("rule_a"), F.col("rule_a").alias("rule_b"))).distinct()


def _scores(pairs: DataFrame) -> DataFrame:
    both, a, b = F.col("co_occurrences"), F.col("total_a"), F.col("total_b")
    return pairs.withColumn("correlation", ratio(both, F.least(a, b))).withColumn("jaccard", ratio(both, a + b - both))


def cooccurrence_of(occurrences: DataFrame, wanted: DataFrame) -> DataFrame:
    """Co-occurrence of the wanted pairs ``(rule_a, rule_b)`` over ``(rule_id, loc)``."""
    occ = occurrences.select("rule_id", "loc").distinct()
    sizes = occ.groupBy("rule_id").agg(F.count("*").alias("n"))
    a = occ.select(F.col("rule_id").alias("rule_a"), "loc")
    b = occ.select(F.col("rule_id").alias("rule_b"), "loc")
    both = wanted.join(a, "rule_a").join(b, ["rule_b", "loc"]).groupBy("rule_a", "rule_b").agg(F.count("*").alias("co_occurrences"))
    zero = F.lit(0).cast("long")
    out = (
        wanted.join(sizes.select(F.col("rule_id").alias("rule_a"), F.col("n").alias("total_a")), "rule_a", "left")
        .join(sizes.select(F.col("rule_id").alias("rule_b"), F.col("n").alias("total_b")), "rule_b", "left")
        .join(both, ["rule_a", "rule_b"], "left")
    )
    return _scores(out.select("rule_a", "rule_b", *[F.coalesce(F.col(c), zero).alias(c) for c in ("co_occurrences", "total_a", "total_b")]))


def correlated_rules(occurrences: DataFrame, min_correlation: float = 0.8, min_support: int = 3) -> DataFrame:
    """All rule pairs sharing at least ``min_support`` locations and the given share of the
    smaller rule's locations. Exact.

    A pair over the threshold t shares at least t*n of the n locations of its smaller rule, so
    it must share one of any n - ceil(t*n) + 1 of them. Only that many are joined, the rarest
    locations first, so a location that carries a third of all findings is hardly ever a join
    key. A large rule is cut into chunks, each with its own prefix: the bound holds in at least
    one chunk. Candidates are then counted exactly.

    A prefix longer by k locations must share k more. Locations of up to ``HOT`` findings cost little
    in the join, so a prefix takes all of them: a pair that meets only by chance is then no candidate,
    whose rule's every location would be joined again.
    """
    occ = occurrences.select("rule_id", "loc").distinct()
    sizes = occ.groupBy("rule_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)
    occ = occ.join(sizes, "rule_id")
    freq = occ.groupBy("loc").agg(F.count("*").alias("f")).filter("f > 1")
    chunk = F.pmod(F.xxhash64("loc"), F.ceil(F.col("n") / CHUNK))
    part = W.partitionBy("rule_id", "chunk")
    ranked = (
        occ.join(freq, "loc", "left").withColumn("chunk", chunk)
        .withColumn("m", F.count("*").over(part))
        .withColumn("rk", F.row_number().over(part.orderBy(F.coalesce("f", F.lit(1)), "loc")))
        .withColumn("cheap", F.count_if(F.coalesce("f", F.lit(1)) <= HOT).over(part))
    )
    needed = F.ceil(F.col("m") * min_correlation - 1e-9)
    whole = F.col("m") == F.col("n")
    needed = F.when(whole, F.greatest(needed, F.lit(min_support))).otherwise(F.greatest(needed, F.lit(1)))
    length = F.greatest(F.col("m") - needed + 1, F.col("cheap"))
    prefix = ranked.withColumn("length", length).filter((F.col("rk") <= F.col("length")) & F.col("f").isNotNull()).select(
        F.col("rule_id").alias("x"), F.col("n").alias("nx"), "chunk", (F.col("length") - F.col("m") + needed).alias("share"), "loc"
    )
    other = occ.join(freq, "loc", "left_semi").select(F.col("rule_id").alias("y"), F.col("n").alias("ny"), "loc")
    met = prefix.join(other, "loc").filter(
        (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    )
    shared = met.groupBy("x", "chunk", "y").agg(F.count("*").alias("c"), F.first("share").alias("share"))
    cand = shared.filter("c >= share").select("x", "y").distinct()
    pairs = cand.select(F.least("x", "y").alias("rule_a"), F.greatest("x", "y").alias("rule_b"))
    out = cooccurrence_of(occ, pairs)
    return out.filter((F.col("co_occurrences") >= min_support) & (F.col("correlation") >= min_correlation))


def mark_related_duplicates(hits: DataFrame, relations: DataFrame, location: list[str], order: list[str]) -> DataFrame:
    """Hits with ``removed`` set where the rule is related to the first hit's rule at that place."""
    first = hits.groupBy(*location).agg(F.min(F.struct(*order, "rule_id")).alias("first"))
    rel = symmetric(relations).select(F.col("rule_a").alias("first_rule"), F.col("rule_b").alias("rule_id"), F.lit(True).alias("related"))
    is_first = F.struct(*order, F.col("rule_id")) == F.col("first")
    marked = hits.join(first, location).withColumn("first_rule", F.col("first.rule_id")).withColumn("is_first", is_first).drop("first")
    # Relations grow with the rules, and their size is guessed from the rule table's: unhinted, all would be broadcast.
    out = marked.join(rel.hint("merge"), ["first_rule", "rule_id"], "left")
    return out.withColumn("removed", F.coalesce("related", F.lit(False)) & ~F.col("is_first")).drop("is_first", "first_rule", "related")


# --- edit conflicts ------------------------------------------------------------------------


def _pair_counts(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: all pairs and overlapping pairs of line ranges, from start and end histograms.

    Two ranges are apart when one ends before the other starts; counting those by position
    needs one row per line of the file, not one per pair of edits.
    """
    marks = F.array(
        F.struct(F.col("line_start").alias("pos"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.col("line_end").alias("pos"), F.lit(0).alias("s"), F.lit(1).alias("e")),
    )
    hist = edits.select(*keys, F.inline(marks)).groupBy(*keys, "pos").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    apart = hist.withColumn("ended", F.coalesce(F.sum("e").over(w), F.lit(0).cast("long")))
    out = apart.groupBy(*keys).agg(F.sum("s").alias("n"), F.sum(F.col("s") * F.col("ended")).alias("apart"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return out.select(*keys, "n", pairs.alias("pairs"), (pairs - F.col("apart")).alias("overlaps"))


def edit_conflicts(edits: DataFrame) -> DataFrame:
    """Per file: conflicting edit pairs of different users, on the same lines or only the file."""
    per_file = _pair_counts(edits, ["file"])
    own = _pair_counts(edits, ["file", "user_id"]).groupBy("file").agg(
        F.sum("pairs").alias("own_pairs"), F.sum("overlaps").alias("own_overlaps")
    )
    same_line = F.col("overlaps") - F.col("own_overlaps")
    return per_file.join(own, "file").select(
        "file", F.col("n").alias("edits"), same_line.alias("same_line"),
        (F.col("pairs") - F.col("own_pairs") - same_line).alias("same_file"),
    )


def overlapping_edits(edits: DataFrame, block: int = 32) -> DataFrame:
    """The overlapping pairs themselves, for a file or time range a user has filtered to.

    Ranges are bucketed by line block, so the join is on (file, block); a pair is reported in
    the block where the later one starts.
    """
    blocks = F.sequence(F.floor(F.col("line_start") / block), F.floor(F.col("line_end") / block))
    cut = edits.withColumn("block", F.explode(blocks))
    a, b = cut.alias("a"), cut.alias("b")
    start = F.greatest(F.col("a.line_start"), F.col("b.line_start"))
    return a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.block") == F.col("b.block"))).filter(
        (F.col("a.edit_id") < F.col("b.edit_id")) & (F.col("a.user_id") != F.col("b.user_id"))
        & (F.col("a.line_start") <= F.col("b.line_end")) & (F.col("b.line_start") <= F.col("a.line_end"))
        & (F.col("a.block") == F.floor(start / block))
    ).select(F.col("a.file").alias("file"), F.col("a.edit_id").alias("edit_a"), F.col("b.edit_id").alias("edit_b"))


# --- ordering edges ------------------------------------------------------------------------


def security_first_edges(tasks: DataFrame, security: Column) -> DataFrame:
    """Edges that make security fixes of a file run before its other fixes.

    Security tasks lead into one gate node per file and the others follow it: the same order as
    an edge between every two of them, with as many edges as tasks.
    """
    gate = F.concat(F.lit("gate-"), F.col("file"))
    both = tasks.groupBy("file").agg(F.bool_or(security).alias("has"), F.bool_or(~security).alias("other")).filter("has AND other")
    here = tasks.join(both.select("file"), "file", "left_semi")
    return here.select(
        "file", F.when(security, F.col("task_id")).otherwise(gate).alias("src"), F.when(security, gate).otherwise(F.col("task_id")).alias("dst")
    )


def prefix_length(n: int, threshold: float) -> int:
    """How many members of a set of ``n`` must be looked up (for tests)."""
    return n - math.ceil(n * threshold - 1e-9) + 1
