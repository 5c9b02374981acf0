"""Token sets and similarity measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.text import let

WORD = r"[\p{L}\p{N}_]+"


def word_list(text: Column) -> Column:
    """Lower-case words of a text, Unicode letters included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(word_list(text))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two token arrays without repeats; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance, tried within narrow bands first: near copies of long texts cost
    length times distance, not length squared. Every band is computed once."""
    wide = let(F.levenshtein(a, b, 512), lambda d: F.when(d >= 0, d).otherwise(F.levenshtein(a, b)))
    return F.when(a == b, 0).otherwise(let(F.levenshtein(a, b, 32), lambda d: F.when(d >= 0, d).otherwise(wide)))


def string_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0 when either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1.0 - edit_distance(a, b) / longer).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; 0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
