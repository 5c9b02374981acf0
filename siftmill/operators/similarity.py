"""Near-duplicate rules and vector clusters.

Clusters are connected components, so the edge list only has to connect what belongs
together. Candidate groups are cut into tiles of bounded size; a tile returns a spanning forest,
never all pairs. A group of copies that holds a third of all rows becomes many tiles and as many
edges as rows. Exact copies are folded before that, near copies by one hub each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.similarity import jaccard, token_set
from siftmill.operators import lettergroups
from siftmill.operators.graph import components
from siftmill.session import written_table

BLOCK = 1500
VECTOR_BLOCK, STRIP_ROWS = 10_000, 512  # vectors on each side of a tile, and compared at once
SMALL_BLOCK, SPLITS = 16, 4
TILE_ROWS, TILE_CHARS = 512, 1 << 20  # rules and their characters on each side of a tile
BLOCK_CHARS, WINDOW, LANES, FEW = 64, 384, 8192, 3  # letters of a block and of a piece of a window, blocks that advance together, pairs that are better computed at once
WORTH, MANY = 2e9, 512  # squared letters of pairs that letter groups tell apart faster than blocks do, tiles whose blocks are compared at once
BANDS = (48, 256, 1024, 4096)  # edits that are tried before the limit
_ONE = np.uint64(1)
PATTERN_WEIGHT, TITLE_WEIGHT, CATEGORY_WEIGHT = 0.5, 0.3, 0.2


def composite(ratio: Column, overlap: Column, same: Column) -> Column:
    """Composite similarity of two rules from that of their patterns, titles and categories."""
    return ratio * PATTERN_WEIGHT + overlap * TITLE_WEIGHT + F.when(same, 1.0).otherwise(0.0) * CATEGORY_WEIGHT


def rule_similarity(a: str, b: str) -> Column:
    """Composite similarity of two rules given as struct columns (pattern, title, category)."""
    x, y = F.col(a), F.col(b)
    return composite(text_ratio(x["pattern"], y["pattern"]), jaccard(token_set(x["title"]), token_set(y["title"])), x["category"] == y["category"])


def text_ratio(a: Column, b: Column) -> Column:
    """``string_ratio`` of long texts, bit-parallel: in the narrowest band that holds the distance, else once."""

    @F.pandas_udf("long")
    def distance(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(x, y, max(len(x), len(y))) if x and y else 0 for x, y in zip(xs, ys)], dtype="int64")

    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1.0 - distance(a, b) / longer).otherwise(0.0)


# --- small numpy helpers -------------------------------------------------------------------


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edit distance, or ``limit + 1`` once it must exceed the limit.

    Bit-parallel over the letters of one text (Hyyro, 2003): a column of the table is a pair of integers, so each letter
    of the other text costs a few integer operations. Narrow bands of the table are tried first, near copies lie in them.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    n = _shared(a, b)
    a, b = a[n:], b[n:]
    n = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    limit = min(limit, len(a))
    places = _places(a)
    for band in BANDS:
        if band < limit and 4 * band < len(a) and len(a) - len(b) <= band:
            dist = _banded(len(a), b, places, band)
            if dist <= band:
                return dist
    return _banded(len(a), b, places, limit) if 3 * limit < len(a) else _whole(len(a), b, places, limit)


def _shared(a: str, b: str) -> int:
    """Letters that both texts begin with."""
    n, most, step = 0, min(len(a), len(b)), 1 << 16
    while step:
        while n + step <= most and a[n : n + step] == b[n : n + step]:
            n += step
        step >>= 1
    return n


def _places(a: str) -> dict[str, int]:
    """Per letter an integer with the bits of its places."""
    codes, at = np.unique(np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    return {chr(c): int.from_bytes(np.packbits(at == k, bitorder="little").tobytes(), "little") for k, c in enumerate(codes.tolist())}


def _whole(n: int, b: str, places: dict[str, int], limit: int) -> int:
    """Distance of a text of n letters, given by their places, and ``b``; ``limit + 1`` beyond the limit."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, left = full, 0, n, len(b)
    for ch in b:
        eq = places.get(ch, 0)
        diagonal = (((eq & up) + up) ^ up) | eq
        vertical = eq | down
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        left -= 1
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if score - left > limit:
            return limit + 1
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
    return min(score, limit + 1)


def _banded(n: int, b: str, places: dict[str, int], limit: int) -> int:
    """``_whole`` within ``limit`` places of the diagonal, for a ``b`` that is not longer and at most ``limit`` shorter. The
    column slides down one letter a step; its last bit follows the lowest diagonal, then the last row."""
    width = 2 * limit + 2
    full, top, row = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    up, down, score, start = full ^ ((1 << (width - limit - 1)) - 1), 0, limit, limit + 1 - width
    most, steep = 2 * limit + len(b) - n, n - limit
    get = places.get
    for i, ch in enumerate(b):
        eq = get(ch, 0)
        eq = (eq >> start if start >= 0 else eq << -start) & full
        start += 1
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = down | (full ^ (diagonal | up)), diagonal & up
        if i < steep:
            if not diagonal & top:
                score += 1
        else:
            if rise & row:
                score += 1
            elif fall & row:
                score -= 1
            row >>= 1
        if score > most:
            return limit + 1
        diagonal >>= 1
        up, down = fall | (full ^ (diagonal | rise)), diagonal & rise
    return min(score, limit + 1)


def _block_distances(codes: np.ndarray, masks: np.ndarray, block: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Per lane a lower bound of the edits that turn the block of ``BLOCK_CHARS`` letters into any piece of
    ``codes[start:stop]``. All lanes take one letter at a time, bit-parallel (Myers, 1999). Their least distance is read
    every fourth letter: it changes by one a letter, so none lies more than two below those read. Wide windows are cut into
    pieces that overlap by two blocks, as a longer match costs a whole block's edits."""
    pieces = np.maximum(-(-(stop - start - 2 * BLOCK_CHARS) // WINDOW), 1)
    of, ahead = np.repeat(np.arange(len(block)), pieces), np.cumsum(pieces) - pieces
    stride = -(-(stop - start - 2 * BLOCK_CHARS) // pieces)[of]
    start = start[of] + stride * (np.arange(len(of)) - ahead[of])
    block, stop = block[of], np.minimum(start + np.maximum(stride, 0) + 2 * BLOCK_CHARS, stop[of])
    width = stop - start
    order = np.argsort(width, kind="stable")
    bound = np.zeros(len(block), np.int64)
    letters, last = masks.shape[1], len(codes) - 1
    width_of, a = width[order], 0
    while a < len(order):
        alike = int(np.searchsorted(width_of, 1.25 * width_of[a], "right"))
        lanes = order[a : min(a + LANES, max(alike, a + LANES // 8))]
        a += len(lanes)
        flat = masks[block[lanes]].ravel()  # next to each other, so that they stay in the cache
        at, base = start[lanes], np.arange(len(lanes)) * letters
        up, down = np.full(len(lanes), ~np.uint64(0)), np.zeros(len(lanes), np.uint64)
        best = np.full(len(lanes), BLOCK_CHARS, np.int64)
        eq, vertical, diagonal, rise = (np.empty_like(up) for _ in range(4))
        place = np.empty_like(at)
        steps = int(width[lanes[-1]])
        np.minimum(at, last - steps + 1, out=at)  # a window that starts earlier only lowers a distance, too
        at = np.maximum(at, 0)
        for step in range(steps):  # narrower windows run on, which only lowers a distance
            np.take(codes, at, out=place, mode="clip")
            place += base
            np.take(flat, place, out=eq, mode="clip")
            at += 1
            np.bitwise_or(eq, down, out=vertical)
            np.bitwise_and(eq, up, out=diagonal)
            diagonal += up
            diagonal ^= up
            diagonal |= eq
            np.bitwise_or(diagonal, up, out=rise)
            np.invert(rise, out=rise)
            rise |= down
            diagonal &= up
            rise <<= _ONE
            diagonal <<= _ONE
            np.bitwise_and(rise, vertical, out=down)
            rise |= vertical
            np.invert(rise, out=up)
            up |= diagonal
            if step % 4 == 3:
                np.minimum(best, np.bitwise_count(up).astype(np.int64) - np.bitwise_count(down), out=best)
        np.minimum(best, np.bitwise_count(up).astype(np.int64) - np.bitwise_count(down), out=best)
        bound[lanes] = np.maximum(best - 2, 0)
    return np.minimum.reduceat(bound, ahead) if len(ahead) else bound


def beyond(xs: list[str], ys: list[str], i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Pairs (xs[i], ys[j]) that must differ by more than ``limit`` edits; the others are undecided.

    An alignment within the limit keeps to a band of diagonals, so every block of x lies in a piece of y's
    window, and the edits of the blocks add up. Half of the blocks tell most unrelated texts apart; what
    is left meets the others.
    """
    out = np.zeros(len(i), bool)
    sizes, lengths = np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)
    blocks = sizes // BLOCK_CHARS
    if len(i) < FEW or not blocks.any():
        return out

    def letters(texts: list[str]) -> np.ndarray:  # letters that share a code only lower a distance
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) & 255

    own, codes = letters(xs), letters(ys)
    used, named = np.unique(own, return_inverse=True)
    number = np.full(256, len(used))  # a letter that no x has
    number[used] = np.arange(len(used))
    codes = number[codes]
    first, from_y = np.cumsum(blocks) - blocks, np.cumsum(lengths) - lengths
    starts = np.repeat(np.cumsum(sizes) - sizes - BLOCK_CHARS * first, blocks) + BLOCK_CHARS * np.arange(blocks.sum())
    masks = np.zeros((len(starts), len(used) + 1), np.uint64)
    for k in range(BLOCK_CHARS):
        masks[np.arange(len(starts)), named[starts + k]] |= np.uint64(1 << k)

    total = np.zeros(len(i), np.int64)
    for part in (1, 0):
        todo = np.flatnonzero(~out)
        ahead = np.cumsum((blocks[i[todo]] + 1 - part) // 2)
        for pairs in np.split(todo, np.searchsorted(ahead, np.arange(8 * LANES, ahead[-1], 8 * LANES)) if len(todo) else []):
            counts = (blocks[i[pairs]] + 1 - part) // 2
            lane = np.repeat(pairs, counts)
            k = 2 * (np.arange(len(lane)) - np.repeat(np.cumsum(counts) - counts, counts)) + part
            n, longer = lengths[j[lane]], lengths[j[lane]] - sizes[i[lane]]
            low, high = (limit[lane] - longer + 1) // 2, (limit[lane] + longer + 1) // 2
            start, stop = np.clip(BLOCK_CHARS * k - low, 0, n), np.clip(BLOCK_CHARS * (k + 1) + high, 0, n)
            least = _block_distances(codes, masks, first[i[lane]] + k, from_y[j[lane]] + start, from_y[j[lane]] + stop)
            np.add.at(total, lane, least)
        out = total > limit
    return out


class Forest:
    """Union-find over the rows of one tile."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


# --- tiles ---------------------------------------------------------------------------------


def into_tiles(rows: DataFrame, keys: list[str], row_id: str, block: int = BLOCK) -> DataFrame:
    """Send each row of a key group to the tiles of its block with every block of the group.

    ``tile_a <= tile_b`` name the tile and ``side`` the block a row belongs to. A group is cut
    into up to ``SPLITS`` blocks to spread its work, and further once blocks would exceed
    ``block`` rows. Groups of one row are dropped, they have no pair.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.greatest(F.ceil(F.col("_n") / block), F.least(F.ceil(F.col("_n") / SMALL_BLOCK), F.lit(SPLITS))).cast("int")
    mine = F.pmod(F.xxhash64(row_id), blocks).cast("int")
    placed = rows.join(sizes, keys).withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.select(
        "*", F.least("_b", "_o").alias("tile_a"), F.greatest("_b", "_o").alias("tile_b"), F.col("_b").alias("side")
    ).drop("_n", "_b", "_o")


def by_tile(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles over all shuffle partitions: few bytes but much work, so small ones stay apart."""
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, *keys)


# --- near-duplicate rules ------------------------------------------------------------------


def title_pairs(titles: DataFrame, share: float) -> DataFrame:
    """(ta, tb, title): distinct titles ``(tid, category, tokens)`` with a token Jaccard index of at least ``share``.

    Two such titles share a token among the first n - ceil(share * n) + 1 of either when tokens are
    ordered by rarity. Under their first one, the tokens that follow bound what else they can share, and so do
    the bits of their token numbers: two titles differ in as many tokens as in bits, at least. What is left is compared.
    """
    flat = titles.filter("category IS NOT NULL").select("tid", "category", F.explode("tokens").alias("token"))
    freq = written_table(flat.groupBy("category", "token").agg(F.count("*").alias("f")).withColumn("no", F.monotonically_increasing_id()), "rule-title-tokens")
    # A title is short, so its tokens are a bounded group.
    word = [F.bit_or(F.expr(f"if(pmod(no, 256) div 64 = {k}, shiftleft(1L, cast(pmod(no, 64) as int)), 0L)")).alias(f"w{k}") for k in range(4)]
    ordered = flat.join(freq, ["category", "token"]).groupBy("tid", "category").agg(F.array_sort(F.collect_list(F.struct("f", "no"))).alias("ts"), *word)
    n = F.size("ts")
    keep = (n - F.ceil(n * share - 1e-9) + 1).cast("int")
    bits = [f"w{k}" for k in range(4)]
    # Rare tokens first, so a hot token only meets titles that have no rarer one to show.
    sized = ordered.select("tid", n.alias("n"), *bits, F.posexplode(F.slice(F.transform("ts", lambda t: t["no"]), 1, keep)).alias("k", "t"))
    left, right = (sized.select("t", *[F.col(c).alias(f"{c}{s}") for c in ("tid", "n", "k", *bits)]) for s in "ab")
    both, least = F.col("na") + F.col("nb"), F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    apart = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in bits), F.lit(0))
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * share - 1e-9) & (least >= both * (share / (1 + share)) - 1e-6) & (apart <= both * ((1 - share) / (1 + share)) + 1e-6)
    near = left.join(right, "t").filter((F.col("tida") < F.col("tidb")) & fits).select(F.col("tida").alias("ta"), F.col("tidb").alias("tb")).distinct()
    words = titles.select("tid", "tokens")
    judged = near.join(words.toDF("ta", "wa"), "ta").join(words.toDF("tb", "wb"), "tb").withColumn("title", jaccard(F.col("wa"), F.col("wb")))
    return judged.filter(F.col("title") >= share - 1e-9).select("ta", "tb", "title")


class _Judge:
    """The composite score of rule pairs of one category whose title index is known."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def limit(self, title: np.ndarray | float, longer: np.ndarray) -> np.ndarray:
        """The most edits between the patterns that reach the threshold."""
        need = (self.threshold - CATEGORY_WEIGHT - TITLE_WEIGHT * title) / PATTERN_WEIGHT
        return np.floor((1.0 - need) * longer + 1e-9).astype(np.int64)

    def score(self, x: str, y: str, title: float) -> float | None:
        longer = max(len(x), len(y))
        limit = int(self.limit(title, np.array(longer)))
        if abs(len(x) - len(y)) > limit:
            return None
        dist = edit_distance(x, y, limit)
        score = (1.0 - dist / longer) * PATTERN_WEIGHT + title * TITLE_WEIGHT + CATEGORY_WEIGHT
        return score if dist <= limit and score >= self.threshold - 1e-12 else None


def _starred(pairs: DataFrame, patterns: DataFrame, judge: _Judge) -> DataFrame:
    """Links among (id, hub, title), one hub per rule, so every text travels once and hubs as often as they have rules."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs, ys, titles = pdf["x"].tolist(), pdf["y"].tolist(), pdf["title"].to_numpy()
            sizes, others = (np.array([len(t) for t in side], np.int64) for side in (xs, ys))
            limit = judge.limit(titles, np.maximum(sizes, others))
            part = np.cumsum(sizes) // TILE_CHARS
            scores: list[float | None] = [None] * len(xs)
            for near in np.split(np.arange(len(xs)), np.flatnonzero(np.diff(part)) + 1):
                near = near[np.abs(sizes[near] - others[near]) <= limit[near]]
                own = np.arange(len(near))
                for k in near[~beyond([xs[k] for k in near], [ys[k] for k in near], own, own, limit[near])].tolist():
                    scores[k] = judge.score(xs[k], ys[k], float(titles[k]))
            out = pd.DataFrame({"src": pdf["id"], "dst": pdf["hub"], "similarity": pd.Series(scores, dtype="float64", index=pdf.index)})
            yield out[out["similarity"].notna()]

    texts = pairs.join(patterns.toDF("id", "x"), "id").join(patterns.toDF("hub", "y"), "hub").select("id", "hub", "title", "x", "y")
    return written_table(by_tile(texts, ["id"]).mapInPandas(check, "src long, dst long, similarity double"), "rule-stars")


def _tiles(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole tiles from batches that are sorted by their keys."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        values = pdf[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(1)][: len(pdf)]).tolist()
        for a, z in zip(starts, starts[1:]):
            yield pdf.iloc[a:z]
        rest = pdf.iloc[starts[-1] :] if starts else None
    if rest is not None:
        yield rest


class _Tile:
    """The pairs (i, j) of a tile that lengths, classes and letter groups leave open, with their limits; ``used`` are their texts."""

    def __init__(self, pdf: pd.DataFrame, judge: _Judge):
        self.ids, self.texts, self.title = pdf["id"].to_numpy(), pdf["pattern"].tolist(), float(pdf["title"].iat[0])
        self.root, self.judge = pdf["class"].to_numpy().copy(), judge
        sizes, side, root, texts = pdf["n"].to_numpy(), pdf["side"].to_numpy(), self.root, self.texts
        order = np.argsort(-sizes, kind="stable")
        left = order[side[order] == 0]
        right = order[side[order] == 1] if side.any() else left
        longer = np.maximum(sizes[left][:, None], sizes[right][None, :])
        limit = judge.limit(self.title, longer)
        near = (np.abs(sizes[left][:, None] - sizes[right][None, :]) <= limit) & (root[left][:, None] != root[right][None, :])
        if not side.any():
            near = np.triu(near, 1)
        first = sizes[left][:, None] >= sizes[right][None, :]
        ahead, behind = (near & k & (longer >= lettergroups.BUCKET) for k in (first, ~first))
        if (longer[ahead] ** 2.0).sum() >= WORTH:
            near &= ~lettergroups.apart([texts[k] for k in left], [texts[k] for k in right], ahead, limit)
        if (longer[behind] ** 2.0).sum() >= WORTH:
            near &= ~lettergroups.apart([texts[k] for k in right], [texts[k] for k in left], behind.T, limit.T).T
        i, j = np.nonzero(near)
        self.i, self.j, self.limit = left[i], right[j], limit[i, j]
        self.used = np.unique(np.r_[self.i, self.j])

    def links(self, beyond: np.ndarray) -> list[tuple[int, int, float]]:
        """Links among the pairs that are not beyond their limits, while they belong to different classes."""
        out, root = [], self.root
        for i, j in zip(self.i[~beyond].tolist(), self.j[~beyond].tolist()):
            if root[i] == root[j]:
                continue
            score = self.judge.score(self.texts[i], self.texts[j], self.title)
            if score is not None:
                out.append((self.ids[i], self.ids[j], score))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
        return out


def _linked(tiles: list[_Tile]) -> pd.DataFrame:
    """Links of some tiles, whose blocks are compared at once."""
    texts = [t.texts[k] for t in tiles for k in t.used.tolist()]
    ahead = np.cumsum([0] + [len(t.used) for t in tiles])
    i, j = (np.concatenate([np.searchsorted(t.used, side) + a for t, side, a in zip(tiles, sides, ahead)]) for sides in ([t.i for t in tiles], [t.j for t in tiles]))
    gone = beyond(texts, texts, i, j, np.concatenate([t.limit for t in tiles]))
    ends = np.cumsum([len(t.i) for t in tiles])
    return pd.DataFrame([link for t, part in zip(tiles, np.split(gone, ends[:-1])) for link in t.links(part)], columns=["src", "dst", "similarity"])


def _tile_links(tiles: DataFrame, patterns: DataFrame, judge: _Judge) -> DataFrame:
    """Links found in tiles: rows (tile key, title, side, id, class, n)."""
    keys = ["ta", "tb", "band_a", "part_a", "band_b", "part_b"]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some, chars = [], 0
        for pdf in _tiles(batches, keys):
            tile = _Tile(pdf, judge)
            some.append(tile)
            chars += len(tile.i) and int(pdf["n"].sum())
            if chars >= TILE_CHARS or len(some) >= MANY:
                yield _linked(some)
                some, chars = [], 0
        if some:
            yield _linked(some)

    full = by_tile(tiles.join(patterns, "id"), keys).sortWithinPartitions(*keys)
    return full.mapInPandas(check, "src long, dst long, similarity double")


def near_duplicate_edges(rules: DataFrame, threshold: float = 0.9, block: int = TILE_ROWS) -> DataFrame:
    """Edges that connect rules ``(id, pattern, title, category)`` above the composite threshold. Exact for thresholds
    above 0.8, where the category must agree.

    Keys first and texts last. Exact copies are folded, then rules of one category and title set: a
    title that a third of all rules have is one row of the title join. Within a title, lengths are
    cut into bands so that partners lie in one band or the next. Every rule is first compared with one
    hub, of its own title or of its largest neighbour; near copies collapse there. Titles that still
    hold several classes are cut into tiles of at most some ``block`` rules and ``TILE_CHARS`` characters
    a side, which spread a hot title's work; only pairs of different classes whose lengths allow it are
    compared. Letter groups that a text picks once (``lettergroups.apart``) drop most unrelated pairs at a cost that
    does not grow with the square of their letters, the summed edits of blocks (``beyond``) nearly all others; the distances
    of the rest are computed bit-parallel in the tasks.
    """
    if threshold <= PATTERN_WEIGHT + TITLE_WEIGHT:
        raise ValueError("the category must be decisive: use a threshold above 0.8")
    judge = _Judge(threshold)
    title_min = (threshold - PATTERN_WEIGHT - CATEGORY_WEIGHT) / TITLE_WEIGHT
    ratio = (threshold - TITLE_WEIGHT - CATEGORY_WEIGHT) / PATTERN_WEIGHT
    sig = F.sha2(F.concat_ws("\x1f", "pattern", "title", "category"), 256)
    info = written_table(rules.select("id", "category", F.array_sort(token_set(F.col("title"))).alias("tokens"), F.length("pattern").alias("n"), sig.alias("sig")), "rule-keys")
    first = info.groupBy("sig").agg(F.min("id").alias("first"))
    marked = info.join(first, "sig").drop("sig")
    copies = marked.filter("id != first").select(F.col("first").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("similarity"))
    unique = marked.filter((F.col("id") == F.col("first")) & (F.size("tokens") > 0) & (F.col("n") > 0))
    titles = written_table(unique.groupBy("category", "tokens").agg(F.min("id").alias("tid"), F.count("*").alias("members")), "rule-titles")
    band = F.floor(F.log("n") / math.log(1.0001 / ratio)).cast("int")
    placed = written_table(unique.join(titles, ["category", "tokens"]).select("id", "n", "tid", "members", band.alias("band")), "rule-places")
    near = written_table(title_pairs(titles, title_min), "rule-title-pairs")
    groups = near.unionByName(titles.filter("members > 1").select(F.col("tid").alias("ta"), F.col("tid").alias("tb"), F.lit(1.0).alias("title")))
    patterns = rules.select("id", "pattern")

    both = near.unionByName(near.select(F.col("tb").alias("ta"), F.col("ta").alias("tb"), "title"))
    best = both.join(titles.select(F.col("tid").alias("tb"), "members"), "tb").groupBy("ta").agg(F.max_by(F.struct("tb", "title"), F.struct("members", -F.col("tb"))).alias("best"))
    hubs = placed.groupBy("tid", "band").agg(F.min("id").alias("hub"))
    own = placed.filter("members > 1").join(hubs, ["tid", "band"]).filter("id != hub").select("id", "hub", F.lit(1.0).alias("title"))
    others = placed.join(best.select(F.col("ta").alias("tid"), F.col("best.tb").alias("tb"), F.col("best.title").alias("title")), "tid")
    others = others.join(hubs.toDF("tb", "band", "hub"), ["tb", "band"]).filter("members = 1").select("id", "hub", "title")
    stars = _starred(own.unionByName(others), patterns, judge)

    known = components(stars).select(F.col("node").alias("id"), "component")
    classed = placed.join(known, "id", "left").withColumn("class", F.coalesce("component", "id"))
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / TILE_CHARS)).cast("int")
    sizes = placed.groupBy("tid", "band").agg(parts.alias("parts"))
    classed = classed.join(sizes, ["tid", "band"]).select("id", "n", "tid", "band", "class", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    classed = written_table(classed, "rule-classes")
    spans = classed.groupBy("tid").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = groups.join(spans.toDF("ta", "la", "ha"), "ta").join(spans.toDF("tb", "lb", "hb"), "tb").filter("least(la, lb) < greatest(ha, hb)").select("ta", "tb", "title")

    def side(own: str, other: str, number: int) -> DataFrame:
        """Every rule of the title ``t<own>`` once per part of the other title's bands that it may have partners in."""
        mine = classed.select(F.col("tid").alias(f"t{own}"), "id", "n", "class", F.col("band").alias(f"band_{own}"), F.col("part").alias(f"part_{own}"))
        theirs = sizes.select(F.col("tid").alias(f"t{other}"), F.col("band").alias(f"band_{other}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{other}"))
        rows = mixed.join(mine, f"t{own}").withColumn(f"band_{other}", F.explode(F.array(*[F.col(f"band_{own}") + k for k in (-1, 0, 1)])))
        rows = rows.join(theirs, [f"t{other}", f"band_{other}"])
        a, b = F.struct("band_a", "part_a"), F.struct("band_b", "part_b")
        once = (F.col("ta") != F.col("tb")) | ((a <= b) if number == 0 else (a < b))
        return rows.filter(once).select("ta", "tb", "title", "band_a", "part_a", "band_b", "part_b", F.lit(number).alias("side"), "id", "class", "n")

    tiles = side("a", "b", 0).unionByName(side("b", "a", 1))
    return copies.unionByName(stars).unionByName(_tile_links(tiles, patterns, judge))


def duplicate_clusters(rules: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(id, cluster) of all rules that have a near duplicate; the cluster is its smallest id."""
    edges = near_duplicate_edges(rules, threshold)
    return components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def dedup_report(clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """Per cluster: size, duplicates, and the mean similarity of its members to the kept rule.

    Every member is compared with the kept rule only, which is linear in the cluster.
    """
    info = F.struct("pattern", "title", "category")
    members = clusters.join(rules.select("id", info.alias("x")), "id")
    kept = rules.join(clusters.select(F.col("cluster").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("cluster"), info.alias("y"))
    scored = members.filter("id != cluster").join(kept, "cluster").withColumn("similarity", rule_similarity("x", "y"))
    return scored.groupBy("cluster").agg(
        (F.count("*") + 1).alias("members"), F.count("*").alias("duplicates"), F.avg("similarity").alias("similarity")
    )


def merged_rules(clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """Per cluster one row: the most confident rule, the number of members and all distinct patterns joined by OR."""
    members = clusters.join(rules, "id")
    primary = members.groupBy("cluster").agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("primary"), F.count("*").alias("members"))
    patterns = members.select("cluster", "pattern").distinct()
    ors = patterns.groupBy("cluster").agg(
        F.when(F.count("*") > 1, F.array_join(F.transform(F.array_sort(F.collect_list("pattern")), lambda p: F.concat(F.lit("("), p, F.lit(")"))), "|"))
        .otherwise(F.first("pattern")).alias("merged_pattern")
    )
    return primary.join(ors, "cluster")


def noise_flags(hits: DataFrame, rules: DataFrame, threshold: int = 100) -> DataFrame:
    """Hits per rule over the corpus and whether the rule is to be demoted."""
    counts = hits.groupBy("rule_id").agg(F.count("*").alias("hits"))
    n = F.coalesce("hits", F.lit(0).cast("long"))
    return rules.join(counts, "rule_id", "left").select("rule_id", n.alias("hits"), (n > threshold).alias("noisy"))


def guardrail(report: DataFrame, clusters: DataFrame, created: DataFrame, noise: DataFrame) -> DataFrame:
    """What happens to each newly created rule: merged, disabled, demoted or kept."""
    members = clusters.join(created.select("id", F.lit(True).alias("new")), "id", "left")
    groups = members.groupBy("cluster").agg(F.bool_or(F.col("new").isNull()).alias("has_old"))
    judged = members.filter("new").join(report, "cluster").join(groups, "cluster")
    action = F.when((F.col("similarity") >= 0.9) & F.col("has_old"), "merge").when(F.col("similarity") >= 0.7, "disable")
    decided = judged.select("id", action.alias("action"))
    out = created.select("id").join(decided, "id", "left").join(noise, "id", "left")
    return out.select("id", F.coalesce("action", F.when(F.col("noisy"), "demote"), F.lit("keep")).alias("action"))


# --- vectors -------------------------------------------------------------------------------


def vector_edges(vectors: DataFrame, threshold: float = 0.85, max_pivots: int = 256, block: int = VECTOR_BLOCK) -> DataFrame:
    """Edges that connect vectors ``(id, embedding)`` with cosine at least ``threshold``. Exact.

    Unit vectors are assigned to the nearest of a fixed number of pivots. A vector can only be
    within reach of a member of another cell when its distance to that pivot is at most the
    cell's radius plus the reach (triangle inequality), so it visits those cells as a guest.
    Pivots are a sample of bounded size; any choice gives the same result.

    Where vectors lie too close for pivots to tell apart (a low threshold), nearly every vector would
    visit nearly every cell; visits are counted before anything is sent, and with fewer copies in plain
    tiles of ``block`` rows a side all vectors are one cell. Vectors travel as binary floats.
    """
    total = vectors.count()
    pivots = min(max_pivots, max(4, math.isqrt(total) // 4))
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("embedding").collect()
    centres = np.array([r["embedding"] for r in sample], dtype=np.float64)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def unit(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        x = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        norm = np.linalg.norm(x, axis=1)
        keep = norm > 0
        return pdf[keep], x[keep] / norm[keep][:, None]

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * x @ centres.T))

    def home_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, x = unit(pdf)
                d = distances(x)
                yield pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "dist": d.min(axis=1)})

    cells = vectors.select("embedding").mapInPandas(home_cells, "cell int, dist double").groupBy("cell").agg(F.max("dist").alias("radius")).collect()
    radius = np.full(len(centres), -np.inf)
    for row in cells:  # one row per pivot, bounded by their number
        radius[row["cell"]] = row["radius"]

    def near_cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(x)
        home = d.argmin(axis=1)
        near = (d <= radius[None, :] + reach + 1e-9) & (np.arange(len(centres))[None, :] > home[:, None])
        near[np.arange(len(home)), home] = True
        return near, home

    def count_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"cell": np.arange(len(centres)), "n": near_cells(unit(pdf)[1])[0].sum(axis=0)}, dtype="int64")

    def copies(n: int) -> int:
        """The rows that ``into_tiles`` makes of a group of ``n``."""
        return n * max(math.ceil(n / block), min(math.ceil(n / SMALL_BLOCK), SPLITS))

    visited = vectors.select("embedding").mapInPandas(count_visits, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    one_cell = copies(total) < sum(copies(row["n"]) for row in visited)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf, x = unit(pdf)
            if one_cell:
                who, cell, guest = np.arange(len(x)), np.zeros(len(x), "int32"), np.zeros(len(x), bool)
            else:
                near, home = near_cells(x)
                who, cell = np.nonzero(near)
                guest = cell != home[who]
            packed = [v.tobytes() for v in np.array(pdf["embedding"].tolist(), dtype=np.float32)]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[who], "cell": cell.astype("int32"), "guest": guest, "packed": [packed[i] for i in who]})

    placed = vectors.select("id", "embedding").mapInPandas(visits, "id long, cell int, guest boolean, packed binary")

    def check_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["packed"]), dtype=np.float32).reshape(len(pdf), -1).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        ids, guest, side = pdf["id"].to_numpy(), pdf["guest"].to_numpy(), pdf["side"].to_numpy()
        a, b = pdf["tile_a"].iat[0], pdf["tile_b"].iat[0]
        left = np.flatnonzero(side == a)
        right = left if a == b else np.flatnonzero(side == b)
        forest, out = Forest(len(pdf)), []
        for start in range(0, len(left), STRIP_ROWS):  # a strip of the tile at a time bounds the memory
            rows = left[start : start + STRIP_ROWS]
            sims = x[rows] @ x[right].T
            i, j = np.nonzero(sims >= threshold)
            p, r = rows[i], right[j]
            keep = ~(guest[p] & guest[r]) & ((p < r) if a == b else True)
            for m, n, s in zip(p[keep].tolist(), r[keep].tolist(), sims[i[keep], j[keep]].tolist()):
                if forest.join(m, n):
                    out.append((ids[m], ids[n], s))
        return pd.DataFrame(out, columns=["src", "dst", "similarity"])

    tiles = into_tiles(placed, ["cell"], "id", block)
    keys = ["cell", "tile_a", "tile_b"]
    return by_tile(tiles, keys).groupBy(*keys).applyInPandas(check_tile, "src long, dst long, similarity double")


def vector_clusters(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Density clusters with a minimum of two points: components of the threshold graph."""
    return components(vector_edges(vectors, threshold)).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
