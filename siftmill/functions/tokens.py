"""Design tokens held in maps: units, colours, keys, merging and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def px_to_rem(value: Column, base: float = 16.0) -> Column:
    px = F.regexp_extract(value, r"^([0-9.]+)px$", 1)
    return F.when(px != "", F.concat((px.cast("double") / base).cast("string"), F.lit("rem"))).otherwise(value)


def hex_to_rgb(value: Column) -> Column:
    """``#RGB``, ``#RRGGBB`` and ``#RRGGBBAA`` as rgb() or rgba(); other values unchanged."""
    raw = F.regexp_extract(value, r"^#([0-9A-Fa-f]+)$", 1)
    full = F.when(F.length(raw) == 3, F.regexp_replace(raw, "(.)", "$1$1")).otherwise(raw)

    def part(i: int) -> Column:
        return F.conv(F.substring(full, i, 2), 16, 10)

    rgb = F.concat_ws(", ", part(1), part(3), part(5))
    alpha = F.format_string("%.2f", part(7).cast("double") / 255)
    return (
        F.when(F.length(full) == 8, F.concat(F.lit("rgba("), rgb, F.lit(", "), alpha, F.lit(")")))
        .when(F.length(full) == 6, F.concat(F.lit("rgb("), rgb, F.lit(")")))
        .otherwise(value)
    )


def map_values(tokens: Column, change) -> Column:
    return F.transform_values(tokens, lambda _, v: change(v))


def flatten(nested: Column, separator: str = "-") -> Column:
    """A map of maps as one map with joined keys."""
    outer = F.map_entries(nested)
    pairs = F.flatten(
        F.transform(outer, lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(F.concat(e["key"], F.lit(separator), x["key"]).alias("key"), x["value"].alias("value"))))
    )
    return F.map_from_entries(pairs)


def prefixed(tokens: Column, prefix: str = "--") -> Column:
    """Entries sorted by key, each key with the prefix unless it has it already."""
    named = F.transform_keys(tokens, lambda k, _: F.when(k.startswith(prefix), k).otherwise(F.concat(F.lit(prefix), k)))
    return F.array_sort(F.map_entries(named))


def merged(first: Column, *later: Column) -> Column:
    """Maps merged key by key, a later source winning."""
    out = first
    for other in later:
        out = F.map_zip_with(out, other, lambda _, a, b: F.coalesce(b, a))
    return out


# Fixed values.
SEMANTIC_COLORS = ["success", "error", "warning", "info"]


def checks(df: DataFrame, colors: str, spacing: str, typography: str) -> DataFrame:
    """Completeness of a project's tokens: counts, missing roles, evenness of the spacing scale."""
    names = F.map_keys(colors)
    missing = [F.when(~F.exists(names, _holds(c)), F.lit(c)) for c in SEMANTIC_COLORS]
    steps = F.filter(F.transform(F.map_values(spacing), lambda v: F.regexp_extract(v, r"^([0-9.]+)", 1)), lambda s: s != "")
    sizes = F.array_sort(F.transform(steps, lambda s: s.cast("double")))
    ratios = F.zip_with(F.slice(sizes, F.lit(2), F.size(sizes)), sizes, lambda b, a: F.when((a > 0) & b.isNotNull(), b / a))
    known = F.filter(ratios, lambda r: r.isNotNull())
    warnings = F.array_compact(
        F.array(
            F.when(F.size(colors) < 10, "few_colors"), F.when(F.size(typography) < 5, "few_type_scales"), F.when((F.size(spacing) > 0) & (F.size(spacing) < 8), "few_spacings"),
            F.when(~F.exists(names, _holds("primary")), "no_primary"), F.when(F.size(F.array_compact(F.array(*missing))) > 0, F.concat(F.lit("missing:"), F.array_join(F.array_compact(F.array(*missing)), "+"))),
            F.when((F.size(known) > 1) & (F.array_max(known) / F.array_min(known) > 2), "uneven_spacing"),
        )
    )
    return df.withColumn("valid", F.size(colors) > 0).withColumn("warnings", warnings)


def _holds(word: str):
    return lambda k: k.contains(word)


def layout_hash(structure: Column) -> Column:
    """First twelve characters of the md5 of the sorted keys."""
    return F.substring(F.md5(F.array_join(F.array_sort(F.map_keys(structure)), "|")), 1, 12)
