"""Benchmark decontamination by spaced seeds.

Fixed masks over a span of tokens ignore some positions, so a substituted word does not hide a
copied passage. Masked windows of test and training texts are hashed and joined; around each hit
the overlap is verified along its diagonal, with substitutions allowed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.base import Memo, slices

#: 1 keeps a token position, 0 ignores it. Every placement of substitutions that ``find_overlaps``
#: allows leaves a window of a mask whole: of the first three in items from eight words on, of all in shorter ones.
MASKS = ("1111", "11101", "1101001")
SHORT_MASKS = ("10111", "11011")
SHORT_WORDS = 8  # items with fewer words also use the short masks
LEAST_WORDS = 5  # items with fewer words are never matched
HITS = 4096  # rows per Arrow batch
BITS = 23  # size of the membership filter: 2**23 bits whatever the input
WORD = re.compile(r"\w+")
_MUL = 0x9E3779B97F4A7C15
_FACTORS = np.random.default_rng(20).integers(1 << 62, 1 << 63, (64, 16)).astype(np.uint64) | np.uint64(1)


def word_ids() -> Memo:
    return Memo(lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little"))


def token_ids(text: str, ids: Memo) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


def masks_for(lengths: set[int]) -> list[tuple[int, ...]]:
    """Kept offsets of every mask for items of these lengths."""
    short = any(LEAST_WORDS <= n < SHORT_WORDS for n in lengths)
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in (*MASKS, *(SHORT_MASKS if short else ()))]


def seeds(tokens: np.ndarray, masks: list[tuple[int, ...]]) -> Iterator[np.ndarray]:
    """For each mask the hash of every window: the kept tokens times fixed odd numbers, which differ by mask and place."""
    for number, mask in enumerate(masks):
        n = max(0, len(tokens) - mask[-1])
        h = np.full(n, number + 1, np.uint64)
        for place, offset in enumerate(mask):
            h += tokens[offset : offset + n] * _FACTORS[number % 64, place]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MUL)
        h ^= h >> np.uint64(29)
        yield h


def _in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, stop, equal words) of the overlap on a diagonal, in one linear scan.

    Around every equal word lies the stretch with the highest score of +1 per equal word and -2 per other word, the
    longer one on a tie. The one with the most equal words counts, then the shorter and the earlier one.
    """
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    n, places = len(same), np.arange(len(same))
    equal = np.concatenate([[0], np.cumsum(same)])
    total = 3 * equal - 2 * np.arange(n + 1)
    falls = np.concatenate([[True], total[1:-1] < np.minimum.accumulate(total[:-1])[:-1]])
    starts = np.maximum.accumulate(np.where(falls, places, 0))[at]
    back = total[:0:-1]
    rises = np.concatenate([[True], back[1:] > np.maximum.accumulate(back)[:-1]])
    stops = n - np.maximum.accumulate(np.where(rises, places, 0))[::-1][at]
    matched = equal[stops] - equal[starts]
    best = np.lexsort((starts, stops - starts, -matched))[0]
    return int(starts[best]), int(stops[best]), int(matched[best])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_matches: int = 12, min_share: float = 0.8) -> DataFrame:
    """Verified overlaps: (key, item, matched, span, doc_start, item_start), one row per key, item and diagonal.

    An overlap is the stretch around an equal word with the highest score of +1 per equal word and -2
    per substituted word, the best of all on the diagonal (``best_stretch``). It counts from ``min_matches`` equal words, or ``min_share`` of the item
    where that is less; items under five words never match. Words are compared without case and
    punctuation. Null and empty texts, keys or items match nothing; repeated rows are matched alike.

    The hashes of the items are the join's one side. The other side is every window of every
    document that passes a membership filter of the items' hashes: its size is fixed, so it may be
    sent to every task; a larger benchmark only lets more windows through to the join.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("t")).filter("item is not null and t is not null")

    def item_rows(batches):
        ids = word_ids()
        for batch in slices(batches):
            rows = [(k, token_ids(t, ids)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [(k, v) for k, v in rows if len(v) >= LEAST_WORDS]
            yield pa.RecordBatch.from_pylist([{"item": k, "words": v.tobytes(), "n": len(v)} for k, v in rows], pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int64())]))

    items = items.mapInArrow(item_rows, "item string, words binary, n bigint").distinct()
    stats = items.groupBy().agg(F.max("n").alias("longest"), F.collect_set(F.when(F.col("n") < SHORT_WORDS, F.col("n"))).alias("short")).first()
    reach = int(stats["longest"] or 0)
    masks = masks_for(set(stats["short"]))

    def item_seeds(batches):
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(raw, np.uint64)
                for number, h in enumerate(seeds(words, masks)):
                    if number < len(MASKS) or len(words) < SHORT_WORDS:
                        out += [{"h": int(x), "item": k, "item_at": i} for i, x in enumerate(h.view(np.int64).tolist())]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("h", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())]))

    seed_rows = items.select("item", "words").mapInArrow(item_seeds, "h bigint, item string, item_at bigint")
    # the filter, built in tasks as set bytes of a fixed range: at most 2**BITS / 8 rows whatever the input
    place = f"shiftrightunsigned(h, {64 - BITS})"
    filled = seed_rows.select(F.expr(f"shiftright({place}, 3)").alias("byte"), F.expr(f"cast(power(2, {place} & 7) as int)").alias("bit"))
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for row in filled.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[row["byte"]] = row["bits"]
    shared = spark.sparkContext.broadcast(bits)

    def doc_hits(batches):
        ids, member = word_ids(), shared.value
        schema = pa.schema([("doc", pa.string()), ("sum", pa.binary()), ("h", pa.int64()), ("at", pa.int64()), ("around", pa.binary())])
        for batch in slices(batches):
            keys, lists = batch.column(0).to_pylist(), [token_ids(t, ids) for t in batch.column(1).to_pylist()]
            stops = np.cumsum([0, *map(len, lists)])
            row = np.repeat(np.arange(len(keys)), np.diff(stops))
            # all texts of the slice in one array: windows that run over the end of a text are left out below
            found = []
            for mask, h in zip(masks, seeds(np.concatenate(lists), masks)):
                at = np.flatnonzero(_in_filter(member, h))
                at = at[row[at] == row[at + mask[-1]]]
                found.append((h[at], at))
            h, at = (np.concatenate(x) for x in zip(*found))
            sums, out = {}, []
            for x, i in zip(h.view(np.int64).tolist(), at.tolist()):
                r = int(row[i])
                words, i = lists[r], int(i - stops[r])
                if r not in sums:
                    sums[r] = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
                out.append({"doc": keys[r], "sum": sums[r], "h": x, "at": i, "around": words[max(0, i - reach) : i + reach].tobytes()})
                if len(out) == HITS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = docs.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("t")).filter("doc is not null and t is not null")
    hits = rows.mapInArrow(doc_hits, "doc string, sum binary, h bigint, at bigint, around binary")
    # rows that repeat a key with another text have their own diagonals; any hit has the whole item around it
    diagonals = hits.join(seed_rows, "h").groupBy("doc", "sum", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.min(F.struct("at", "around")).alias("hit"))

    def verify(batches):
        schema = pa.schema([("doc", pa.string()), ("item", pa.string()), ("matched", pa.int64()), ("span", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                around, words = np.frombuffer(r["around"], np.uint64), np.frombuffer(r["words"], np.uint64)
                shift = r["diagonal"] - max(0, r["at"] - reach)  # place of the item's first word in the cut
                lo, hi = max(0, -shift), min(len(words), len(around) - shift)
                same = around[lo + shift : hi + shift] == words[lo:hi]
                a, b, matched = best_stretch(same)
                if matched >= min(min_matches, int(np.ceil(min_share * len(words)))):
                    out.append({"doc": r["doc"], "item": r["item"], "matched": matched, "span": b - a, "doc_start": r["diagonal"] + lo + a, "item_start": lo + a})
            yield pa.RecordBatch.from_pylist(out, schema)

    checked = diagonals.join(items.select("item", "words"), "item").select("doc", "item", "diagonal", "hit.at", "hit.around", "words")
    found = checked.mapInArrow(verify, "doc string, item string, matched bigint, span bigint, doc_start bigint, item_start bigint").distinct()
    cast = lambda name, frame, col: F.col(name).cast(frame.schema[col].dataType).alias(col)
    return found.select(cast("doc", docs, key), cast("item", benchmark, item), "matched", "span", "doc_start", "item_start")


def flag(docs: DataFrame, overlaps: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: key, contaminated, n_items, the item with most equal words (smallest id on a tie) and their number."""
    best = overlaps.groupBy(key).agg(F.count_distinct(item).cast("bigint").alias("n_items"), F.max("matched").alias("matched"), F.min_by(item, F.struct(-F.col("matched"), F.col(item))).alias(item))
    out = docs.select(key).join(best, key, "left")
    return out.select(key, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), item, F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs``, with all their columns, that overlap with no item. Rows with a null key stay."""
    bad = find_overlaps(docs, benchmark, key, **options).select(F.col(key).alias("bad_key")).distinct()
    return docs.join(bad, F.col(key) == F.col("bad_key"), "left_anti")
