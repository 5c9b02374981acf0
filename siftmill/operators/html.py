"""Detectors over HTML: class attributes, components, and features of a page.

Tags and class strings are extracted inside the page row; tests of a class string are literal
expressions. Nothing shuffles before the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import let

# Utility classes that conflict on one element.
CONFLICTS = {
    "max-w-* conflicts with w-full": (r"max-w-\w+", r"\bw-full\b"),
    "hidden conflicts with block": (r"\bhidden\b", r"\bblock\b"),
    "fixed conflicts with absolute": (r"\bfixed\b", r"\babsolute\b"),
    "static conflicts with relative": (r"\bstatic\b", r"\brelative\b"),
}
# Light classes and the dark ones that cover them.
DARK_PAIRS = {
    "bg-white": ["dark:bg-gray-900", "dark:bg-gray-800", "dark:bg-slate-900"],
    "bg-gray-50": ["dark:bg-gray-800", "dark:bg-gray-900"],
    "bg-gray-100": ["dark:bg-gray-800", "dark:bg-gray-700"],
    "text-gray-900": ["dark:text-white", "dark:text-gray-100"],
    "text-gray-700": ["dark:text-gray-300", "dark:text-gray-200"],
    "text-gray-500": ["dark:text-gray-400"],
    "text-gray-600": ["dark:text-gray-400", "dark:text-gray-300"],
    "border-gray-200": ["dark:border-gray-700", "dark:border-gray-600"],
    "border-gray-300": ["dark:border-gray-600", "dark:border-gray-700"],
}
BREAKPOINTS = ["sm", "md", "lg", "xl", "2xl"]
_PREFIX = r"(?:(2xl|xl|lg|md|sm):)?"
PAGES = 256  # pages whose elements are Python objects at a time
ELEMENTS = 1 << 16  # scored elements that a task remembers
LONG = 256  # letters of an element that is remembered


def class_strings(html: Column) -> Column:
    """The values of all class attributes, in page order."""
    return F.regexp_extract_all(html, F.lit(r"class=\"([^\"]*)\""), F.lit(1))


def _capped(items: Column, cap: int) -> Column:
    return F.slice(items, 1, cap) if cap else items


def class_conflicts(pages: DataFrame, cap: int = 10) -> DataFrame:
    """Class strings holding both classes of a conflict under the same breakpoint prefix."""

    def judge(c: Column) -> Column:
        found = []
        for name, (a, b) in CONFLICTS.items():
            same = F.regexp_extract(c, _PREFIX + a, 1) == F.regexp_extract(c, _PREFIX + b, 1)
            found.append(F.when(c.rlike(a) & c.rlike(b) & same, F.struct(F.lit(name).alias("conflict"), F.substring(F.trim(c), 1, 100).alias("match_text"))))
        return F.array_compact(F.array(*found))

    hits = F.flatten(F.transform(class_strings(F.col("content")), judge))
    return pages.select("project", "path", F.inline(_capped(hits, cap)))


def missing_dark_variants(pages: DataFrame, cap: int = 10, pairs: dict[str, list[str]] = DARK_PAIRS) -> DataFrame:
    """Light classes without an accepted dark class or any dark class of the same property."""

    def judge(c: Column) -> Column:
        def of_tokens(tokens: Column) -> Column:
            found = []
            for base, dark in pairs.items():
                prop = base.split("-")[0]
                lacks = ~F.arrays_overlap(tokens, F.array(*[F.lit(d) for d in dark])) & ~_has_prefix(tokens, f"dark:{prop}-")
                found.append(F.when(F.array_contains(tokens, base) & lacks, F.struct(F.lit(base).alias("base_class"), F.substring(F.trim(c), 1, 100).alias("match_text"))))
            return F.array_compact(F.array(*found))

        return let(F.split(F.trim(c), r"\s+"), of_tokens)

    hits = F.flatten(F.transform(class_strings(F.col("content")), judge))
    return pages.select("project", "path", F.inline(_capped(hits, cap)))


def _has_prefix(tokens: Column, prefix: str) -> Column:
    return F.exists(tokens, lambda t: t.startswith(prefix))


def missing_base_styles(pages: DataFrame, pattern: str) -> DataFrame:
    """Properties that appear under a breakpoint but have no base style in the same element.

    A numbered property (``grid-cols-3``) is covered by any base class of its family.
    """
    prefix = r"^(sm|md|lg|xl|2xl):"

    def judge(c: Column) -> Column:
        def of_tokens(tokens: Column) -> Column:
            base = F.filter(tokens, lambda t: ~t.rlike(prefix))
            props = F.array_distinct(F.transform(F.filter(tokens, lambda t: t.rlike(prefix)), lambda t: F.regexp_replace(t, prefix, "")))

            def lacks(p: Column) -> Column:
                family = F.regexp_extract(p, r"^(.+)-[0-9]+$", 1)
                return p.rlike(pattern) & ~F.array_contains(base, p) & (family != "") & ~F.exists(base, lambda b: b.startswith(family))

            def issue(p: Column) -> Column:
                shown = F.filter(tokens, lambda t: t.rlike(prefix) & (F.regexp_replace(t, prefix, "") == p))
                prefixes = F.transform(shown, lambda t: F.regexp_extract(t, prefix, 1))
                return F.struct(p.alias("property"), F.array_join(prefixes, "/").alias("prefixes"), F.substring(F.trim(c), 1, 100).alias("match_text"))

            return F.transform(F.filter(props, lacks), issue)

        return let(F.split(F.trim(c), r"\s+"), of_tokens)

    hits = F.flatten(F.transform(class_strings(F.col("content")), judge))
    return pages.select("project", "path", F.inline(hits))


# --- components ----------------------------------------------------------------------------

# How a component looks, (tags, class fragments, structure, position, minimum in tenths).
COMPONENTS = {
    "header": (["header", "nav"], ["sticky", "fixed", "top-0", "z-50", "z-40"], "contains_nav_or_logo", "top", 7),
    "hero": (["section"], ["h-screen", "h-[600px]", "h-[500px]", "hero", "banner"], "has_h1_and_button", "first_section", 7),
    "card": (["div", "article"], ["rounded-", "shadow-", "p-", "card", "bg-"], "icon_title_text", None, 6),
    "button": (["button", "a"], ["px-", "py-", "rounded-", "btn", "button"], "clickable", None, 5),
    "badge": (["span", "div"], ["rounded-full", "text-xs", "text-sm", "inline-flex", "badge"], "small_inline", None, 6),
    "carousel": (["div", "section"], ["overflow-hidden", "flex", "animate-", "carousel", "slider"], "scrollable_items", None, 7),
    "grid": (["div", "section"], ["grid", "grid-cols-"], "multiple_children", None, 6),
    "icon": (["span", "i"], ["material-symbols-outlined", "icon", "fa-"], None, None, 8),
    "image": (["img"], ["object-cover", "object-contain"], None, None, 5),
    "section": (["section"], ["py-", "max-w-"], "has_heading", None, 5),
    "container": (["div"], ["max-w-", "mx-auto", "px-", "container"], None, None, 6),
    "nav-link": (["a"], ["hover:", "transition-"], "in_nav", None, 6),
    "input": (["input", "textarea", "select"], ["border", "rounded-"], None, None, 7),
    "modal": (["div"], ["fixed", "inset-0", "z-50", "modal"], None, None, 8),
    "dropdown": (["div"], ["absolute", "top-full", "shadow-", "dropdown"], None, None, 7),
    "tabs": (["div"], ["flex", "border-b", "gap-", "tabs"], "multiple_clickable", None, 7),
    "accordion": (["div"], ["collapsible", "transition-", "accordion"], "expandable", None, 7),
    "breadcrumb": (["nav", "div"], ["flex", "gap-", "text-sm", "breadcrumb"], "has_separators", None, 7),
    "footer": (["footer"], ["bg-", "py-"], None, "bottom", 7),
    "form": (["form"], [], "has_inputs", None, 8),
}


def page_flags(html: Column) -> dict[str, Column]:
    """Structure terms that need a tree, reduced to flags of the page."""
    return {
        "contains_nav_or_logo": html.rlike(r"<nav|class=\"[^\"]*logo"),
        "has_h1_and_button": html.rlike(r"<h1") & html.rlike(r"<button"),
        "icon_title_text": html.rlike(r"class=\"[^\"]*(icon|material-symbols)") & html.rlike(r"<h[1-4]") & html.rlike(r"<p"),
        "scrollable_items": F.regexp_count(html, F.lit(r"<li")) >= 3,
        "multiple_children": F.regexp_count(html, F.lit(r"<p")) >= 2,
        "has_heading": html.rlike(r"<h[1-3]"),
        "in_nav": html.rlike(r"<nav"),
        "multiple_clickable": F.regexp_count(html, F.lit(r"<(a|button)[ >]")) >= 2,
        "has_separators": F.regexp_replace(html, r"<[^>]*>", "").rlike("[/>›]"),
        "has_inputs": html.rlike(r"<(input|textarea|select)"),
    }


_OPENED = re.compile(r"<[A-Za-z][A-Za-z0-9]*[^>]*>")
_NAME = re.compile(r"<([A-Za-z0-9]+)")
_CLASS = re.compile(r'class="([^"]*)"')
_INLINE = re.compile("inline|flex")
_TOP, _BOTTOM, _FIRST = 1, 2, 4  # places of an element, as bits
_PLACES = {"top": _TOP, "bottom": _BOTTOM, "first_section": _FIRST}


def component_of(element: str, flags: frozenset[str], places: int, minimum_offset: int = 0) -> tuple[str, str, str, int] | None:
    """(tag, cls, component type, score) of an opening tag, or None where no type is reached."""
    tag = _NAME.match(element)[1].lower()
    cls = found[1] if (found := _CLASS.search(element)) else ""
    own = {"clickable": tag in ("button", "a"), "small_inline": bool(_INLINE.search(cls)), "expandable": "transition" in cls}
    best = None
    for kind, (tags, frags, structure, place, minimum) in COMPONENTS.items():
        score = (3 if tag in tags else 0) + min(4, sum(f in cls for f in frags))
        score += 3 if own.get(structure, structure in flags) else 0
        score = min(10, score + (2 if places & _PLACES.get(place, 0) else 0))
        if score >= minimum + minimum_offset and (best is None or score > best[3]):
            best = tag, cls, kind, score
    return best


def components_of(pages: DataFrame, minimum_offset: int = 0) -> DataFrame:
    """Component type of every opening tag that reaches a type's minimum score.

    Scores are tenths: 3 for the tag, 1 per class fragment up to 4, 3 for structure, 2 for
    position. An element keeps its best type; the first type listed wins a tie. Pages repeat
    their elements, so a task scores equal ones once, in a bounded table.
    """
    flags = page_flags(F.col("content"))
    names = list(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(ELEMENTS)(component_of)
        named = lru_cache(None)(lambda bits: frozenset(n for i, n in enumerate(names) if bits >> i & 1))
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                rows = []
                for project, path, content, bits in zip(*(c.to_pylist() for c in batch.slice(start, PAGES).columns)):
                    elements = _OPENED.findall(content)
                    first = next((i for i, e in enumerate(elements) if _NAME.match(e)[1].lower() == "section"), -1)
                    holds = named(bits)
                    # "top" and "bottom": among the first and the last ten tags, head included.
                    for i, e in enumerate(elements):
                        places = (_TOP if i < 10 else 0) | (_BOTTOM if i >= len(elements) - 10 else 0) | (_FIRST if i == first else 0)
                        found = (known if len(e) <= LONG else component_of)(e, holds, places, minimum_offset)
                        if found:
                            rows.append((project, path, i, *found))
                columns = zip(*rows) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["project", "path", "pos", "tag", "cls", "component_type", "score"])

    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(flags.values())), F.lit(0))
    held = pages.filter(F.col("content").isNotNull()).select("project", "path", "content", bits.alias("flags"))
    return held.mapInArrow(run, "project string, path string, pos int, tag string, cls string, component_type string, score int")


# --- features ------------------------------------------------------------------------------


def _count(text: Column, literal: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


SEMANTIC_TAGS = ["header", "nav", "section", "article", "aside", "footer", "main"]
INTERACTIVE_TAGS = ["button", "a", "input", "select", "textarea"]
FEATURES = [
    "html_kchars", "tag_count", "class_count", "semantic_count", "interactive_count", "has_flex", "has_grid", "has_container",
    "text_ratio", "classes_per_tag", "has_heading", "has_image", "has_list", "nesting", "type_length", "semantic_parent",
    "siblings", "has_responsive", "responsive_ratio", "has_color", "has_spacing", "has_fullwidth", "is_top", "is_bottom", "interactive_density",
]


def html_features(pages: DataFrame, component_type: Column) -> DataFrame:
    """The 25 numbers that describe an HTML snippet to the component classifier."""
    html, low = F.col("content"), F.lower("content")
    base = pages.withColumn("_n", F.length(html)).withColumn("_tags", _count(html, "<")).withColumn(
        "_classes", F.filter(F.split(F.array_join(class_strings(html), " "), r"\s+"), lambda c: c != "")
    ).withColumn("_parent", F.regexp_extract(html, r"<([A-Za-z0-9_]+)", 1)).withColumn(
        "_inter", sum((_count(low, f"<{t}") for t in INTERACTIVE_TAGS[1:]), _count(low, f"<{INTERACTIVE_TAGS[0]}"))
    )
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    classes, tags = F.col("_classes"), F.col("_tags")
    text = F.trim(F.regexp_replace(html, r"<[^>]+>", ""))
    responsive = F.size(F.filter(classes, lambda c: c.rlike(r"^(sm|md|lg|xl|2xl):")))
    values = [
        F.col("_n") / 1000, tags, _count(html, "class="), sum((_count(low, f"<{t}") for t in SEMANTIC_TAGS[1:]), _count(low, "<header")),
        F.col("_inter"), flag(html.contains("flex")), flag(html.contains("grid")), flag(html.contains("container")),
        F.when(F.col("_n") > 0, F.length(text) / F.col("_n")).otherwise(0.0), F.size(classes) / F.greatest(tags, F.lit(1)),
        flag(html.rlike(r"<h[1-6]")), flag(html.contains("<img")), flag(html.rlike("<ul|<ol")), _count(html, "<div") + _count(html, "<section"),
        F.length(component_type), flag(F.col("_parent").isin(SEMANTIC_TAGS)), F.regexp_count(html, F.lit(r">\s*<")) / 10,
        flag(responsive > 0), responsive / F.greatest(F.size(classes), F.lit(1)), flag(F.exists(classes, lambda c: c.rlike("bg-|text-|border-"))),
        flag(F.exists(classes, lambda c: c.rlike("p-|px-|py-|m-|mx-|my-|gap-|space-"))),
        flag(F.arrays_overlap(classes, F.array(F.lit("w-full"), F.lit("w-screen"), F.lit("min-w-full")))),
        flag(F.col("_parent").isin("header", "nav")), flag(F.col("_parent") == "footer"), F.col("_inter") / F.greatest(tags, F.lit(1)),
    ]
    return base.select("project", "path", *[v.cast("double").alias(n) for n, v in zip(FEATURES, values)])
