"""Texts within an edit ratio of each other, joined on segments of the shorter one.

A text of l characters is cut into one segment more than the most edits that any partner of at
least its length may need. Every pair then has a segment of the shorter text untouched in the longer
one, at a place that the edits before and behind it bound. So a text is indexed by its segments and
probed by its own pieces at those places, as an equi-join on hashes; lengths and places are part
of the key. Texts beyond ``SEGMENTED`` characters, whose segments would stay as short while their
pieces grow with the cube of the length, are keyed by length alone.

Links connect; they do not list every pair of a group. Of each key one hub is compared first: copies
of a template collapse there, linearly. Only keys that then still hold several classes are joined,
and only texts of different classes are compared. Distances are the JVM's, within the pair's limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators.graph import components
from siftmill.session import drop_table, written_table

SEGMENTED = 128


def allowed(longer: str, threshold: float) -> str:
    """The most edits of a pair whose longer text has that many characters."""
    return f"cast(floor({1.0 - threshold!r} * ({longer}) + 1e-9) as int)"


def _cuts(length: str, threshold: float) -> str:
    """The most edits between a text and a partner that is not shorter."""
    return allowed(f"floor({length} / {threshold!r} + 1e-9)", threshold)


def _start(length: str, k: str, cuts: str) -> str:
    return f"cast(({k}) * {length} div ({cuts} + 1) as int)"


def segment_keys(threshold: float, segmented: int = SEGMENTED) -> tuple[str, str]:
    """SQL for the index keys and the probe keys of a ``text`` of ``n`` characters, arrays of hashes."""
    own = _cuts("n", threshold)
    a, b = _start("n", "k", own), _start("n", "k + 1", own)
    index = f"transform(sequence(0, {own}), k -> xxhash64(n, k, substring(text, {a} + 1, {b} - {a})))"
    index = f"CASE WHEN n <= {segmented} THEN {index} ELSE array(xxhash64(n, -1, '')) END"
    cuts = _cuts("l", threshold)
    a, b = _start("l", "k", cuts), _start("l", "k + 1", cuts)
    low = f"greatest({a} - k, {a} + n - l - ({cuts} - k), 0)"
    high = f"least({a} + k, {a} + n - l + ({cuts} - k), n - ({b} - {a}))"
    places = f"if({low} <= {high}, transform(sequence({low}, {high}), p -> xxhash64(l, k, substring(text, p + 1, {b} - {a}))), array())"
    least = f"n - {allowed('n', threshold)}"
    short = f"if({least} <= {segmented}, flatten(transform(sequence({least}, least(n, {segmented})), l -> flatten(transform(sequence(0, {cuts}), k -> {places})))), array())"
    long = f"if(n > {segmented}, transform(sequence(greatest({least}, {segmented} + 1), n), l -> xxhash64(l, -1, '')), array())"
    return f"array_distinct({index})", f"array_distinct(concat({short}, {long}))"


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, name: str) -> DataFrame:
    """(src, dst, similarity) of the pairs (a, b) whose ratio reaches the threshold."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    longer = "greatest(length(x), length(y))"
    judged = pairs.join(left, "a").join(right, "b").withColumn("dist", F.expr(f"levenshtein(x, y, {allowed(longer, threshold)})"))
    return written_table(judged.filter("dist >= 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.expr(f"1.0 - dist / {longer}").alias("similarity")), name)


def edit_links(texts: DataFrame, keys: list[str], threshold: float, segmented: int = SEGMENTED) -> DataFrame:
    """Links (src, dst, similarity) that connect the texts ``(id, text)`` of a key whose edit ratio reaches ``threshold``.

    The ratio is 1 - edit distance / longer length; thresholds are above 0.5. Ids are unique. Empty
    and null texts link with nothing.
    """
    if threshold <= 0.5:
        raise ValueError("segments need a threshold above 0.5")
    sized = texts.select(*keys, "id", "text", F.length("text").alias("n")).filter("n > 0")
    index_keys, probe_keys = segment_keys(threshold, segmented)
    index = written_table(sized.select(*keys, "id", F.explode(F.expr(index_keys)).alias("h")), "edit-index")
    hubs = index.groupBy(*keys, "h").agg(F.min("id").alias("hub"))
    probes = sized.select(*keys, "id", F.explode(F.expr(probe_keys)).alias("h"))
    met = written_table(probes.join(hubs, [*keys, "h"]), "edit-met")

    stars = met.filter("id != hub").groupBy("id", "hub").count().groupBy("id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    first = _verified(stars.select(F.col("id").alias("a"), F.col("hub").alias("b")), texts, threshold, "edit-stars")
    known = components(first).select(F.col("node").alias("id"), "component")

    def classed(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, "h", "id").join(known, "id", "left").select(*keys, "h", "id", F.coalesce("component", "id").alias("class"))

    indexed, probing = classed(index), classed(met)
    ends = [F.min("class").alias("low"), F.max("class").alias("high")]
    spans = indexed.groupBy(*keys, "h").agg(*ends).unionByName(probing.groupBy(*keys, "h").agg(*ends))
    mixed = spans.groupBy(*keys, "h").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select(*keys, "h")
    left = probing.join(mixed, [*keys, "h"], "left_semi").select(*keys, "h", F.col("id").alias("x"), F.col("class").alias("cx"))
    right = indexed.join(mixed, [*keys, "h"], "left_semi").select(*keys, "h", F.col("id").alias("y"), F.col("class").alias("cy"))
    pairs = left.join(right, [*keys, "h"]).filter("cx != cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = _verified(pairs, texts, threshold, "edit-pairs")
    drop_table(index, met)
    return first.unionByName(more)
