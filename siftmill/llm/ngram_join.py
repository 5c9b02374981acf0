"""N-gram Jaccard join on a count-vector R-tree, and the classes that its links form.

A document's set of word shingles is hashed into groups; the counts per group are a point. Two
sets overlap in at most the sum of the smaller counts, so linked sets of n and m shingles have
points at most (n + m) / 19 apart at a similarity of 0.9 (in general: ``Bands.reach``).

1. *Cells.* No box of a single tree over many groups keeps random texts apart, so the groups are
   dealt into more blocks than the greatest distance of a linked pair: some block then has
   equal counts in both. Points that share such a block meet in its cell. Sizes are cut in bands so
   that both know the number of blocks.
   A set leaves out its fullest cells, as many as links can spare: a common line's cell is hardly met in.
2. *Stars.* In every cell the most central member stands for it; each point is compared exactly with
   the one such hub it shares most cells with. Groups of near copies collapse here, linearly.
3. *R-trees.* Cells that still hold several classes get R-trees over whole points. Boxes and then
   points are dropped by the summed smaller coordinates; pairs of one class are skipped. Points that
   are near are bounded once more by many more groups before a pair leaves the cell. Large cells are
   cut into pages and all pairs of pages visited.
4. Surviving pairs are verified on the exact sets. Classes are the connected components of all links.

Everything is exact at every size: no caps, and hubs and classes only skip pairs whose class is known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftmill.llm.base import Memo, from_planes, planes, slices, small_batches
from siftmill.operators.graph import components
from siftmill.session import drop_table, written_table

GROUPS = 64  # coordinates of the points in the R-trees
FINE = 1024  # coordinates of the points that candidates are bounded by, enough to tell sets of thousands of shingles apart; a multiple of GROUPS
MOST = 255  # greatest count of a fine group; what is above it is known as a sum
BLOCK_GROUPS = 1 << 20  # groups of a block: so many that blocks of few shingles rarely agree by chance
SENT = 1 << 18  # pairs that a task remembers, not to send them again from the next cell they share
PAGE = 2048  # members of a cell that meet in one task
LEAF = 32
ROW_CELLS = 1 << 18  # cells of a profile row
BUCKET_CELLS = 1 << 19  # cells that meet in a task, on average
BAND_BITS = 6  # of a cell id; the last of 64 bands holds sets of 10^10 shingles
_BANDS = (1 << BAND_BITS) - 1
_M = np.uint64(0x9E3779B97F4A7C15)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _M
    h = (h ^ (h >> _S29)) * _M
    return h ^ (h >> _S32)


def shingles(text: str | None, memo: Memo, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles. Words: runs without ASCII blanks, A-Z lower-cased.
    Fewer words than ``width`` are one shingle; no words, no shingle."""
    words = text.encode().lower().split() if text else []
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(width, len(ids))
    if not n:
        return ids
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * _M + ids[k : len(ids) - n + 1 + k])
    return np.unique(h)


def _memo() -> Memo:
    return Memo(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), entries=200_000)


class Bands:
    """Size bands and their numbers of blocks for links of at least ``percent`` similarity."""

    def __init__(self, percent: int):
        self.percent = percent

    def edges(self, upto: int) -> list[int]:
        out = [1]
        while out[-1] <= upto:
            out.append(max(out[-1] + 1, out[-1] * 3 // 2))
        return out

    def reach(self, low_size: int) -> int:
        """Greatest distance of a linked pair whose smaller set has ``low_size`` shingles: the larger has at most
        100 / percent as many, and the distance is at most (n + m)(100 - percent) / (100 + percent)."""
        return low_size * (100 - self.percent) // self.percent

    @staticmethod
    def blocks(reach: int) -> int:
        """Half more than the least number, so that the blocks with shingles are more than ``reach`` even where a block
        gets no more than three: a cell of an empty block would hold a constant share of all sets of a size."""
        return reach + 1 + (reach // 2 + 1 if reach else 0)

    def cells(self, h: np.ndarray) -> np.ndarray:
        """Cell ids of a set: in its own band, and in the band of the smallest set that it may link with. Their last
        ``BAND_BITS`` bits name the band."""
        return np.concatenate([np.empty(0, np.uint64), *(key[held] for _, _, key, held in self._blocks(h))])

    def spare(self, h: np.ndarray) -> list[dict[str, int]]:
        """Per band how many of the set's cells may be left out: at most ``reach`` blocks of linked sets differ, so of c
        cells they share c - reach, and one that is shared stays whichever of the others are dropped. Sets that hold
        cells of empty blocks may share fewer and spare none."""
        return [{"band": band & _BANDS, "spare": spare} for band, spare, _, _ in self._blocks(h)]

    def _blocks(self, h: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(band, cells to spare, cell ids, which of them the set lies in)."""
        n = len(h)
        if not n:
            return
        least, bounds = -(-n * self.percent // 100), self.edges(n)
        for band in range(len(bounds) - 1):
            if bounds[band + 1] <= least or bounds[band] > n:
                continue
            reach = self.reach(bounds[band + 1] - 1)
            blocks = self.blocks(reach)
            g = _mix(h + np.uint64(band + 1))
            block = (g % np.uint64(blocks)).astype(np.int64)
            point = _mix((g // np.uint64(blocks)) % np.uint64(BLOCK_GROUPS) + np.uint64(1))
            total = np.zeros(blocks, np.uint64)
            np.add.at(total, block, point)  # a linear hash of the block's counts
            held = np.bincount(block, minlength=blocks) > 0
            spare = max(int(held.sum()) - reach - 1, 0)
            if held.sum() <= reach:  # too few blocks with shingles: the shared block may be an empty one
                held[:] = True
            key = _mix(total + _mix(np.arange(blocks, dtype=np.uint64) + np.uint64(band << 40)))
            yield band, spare, key & ~np.uint64(_BANDS) | np.uint64(band & _BANDS), held


def _profiles(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """One row per some million cells: keys and sizes of its texts, and the cells that they lie in.

    ``cells`` are sorted, ``places`` says whose each is. A cell of several texts of the row is known to
    be shared: these stand in ``shared_cells`` and ``shared_ids``, and ``cells`` keeps the first of them,
    marked in ``known``. So a cell that a third of all texts lie in is met once per row, not per text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        ids: list[int | None] = []
        sizes: list[int] = []
        cells: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            every = np.concatenate(cells)
            place = np.repeat(np.arange(len(cells), dtype=np.uint32), list(map(len, cells)))
            if None in ids:  # rows without a key link with nothing
                keep = np.array([i is not None for i in ids])[place]
                every, place = every[keep], place[keep]
            order = np.argsort(every, kind="stable")
            every, place = every[order], place[order]
            first = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.empty(0, bool)
            again = ~first
            known = np.zeros(len(every), bool)
            known[:-1] = again[1:]
            several = again | known
            numbers = np.array([-1 if i is None else i for i in ids], np.int64)
            values = [[ids], [sizes], [planes(np.diff(every[first], prepend=np.uint64(0)))], [planes(place[first])], [np.packbits(known[first]).tobytes()], [int(first.sum())]]
            values += [[every[several].view(np.int64)], [numbers[place[several]]]]
            longs = pa.list_(pa.int64())
            kinds = [longs, longs, pa.binary(), pa.binary(), pa.binary(), pa.int64(), longs, longs]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["ids", "sizes", "cells", "places", "known", "held", "shared_cells", "shared_ids"])

        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingles(text, memo, width)
                ids.append(key)
                sizes.append(len(h))
                cells.append(bands.cells(h))
                held += len(cells[-1])
                if held >= ROW_CELLS or len(ids) >= ROW_CELLS:
                    yield row()
                    ids, sizes, cells, held = [], [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(run, "ids array<bigint>, sizes array<bigint>, cells binary, places binary, known binary, held bigint, shared_cells array<bigint>, shared_ids array<bigint>")


def _shared_cells(profiles: DataFrame) -> DataFrame:
    """(cell, id) of every cell that several texts lie in. Cells are dealt by their leading bits into buckets of some
    million; a bucket gets each cell at most once per profile row."""
    held = profiles.agg(F.sum("held")).first()[0] or 0
    bits = (held // BUCKET_CELLS).bit_length()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, cells, places, known = (batch.column(k)[0].as_py() for k in range(4))
            cells = np.cumsum(from_planes(cells, "<u8"), dtype=np.uint64)
            numbers = np.array([-1 if i is None else i for i in ids], np.int64)[from_planes(places, "<u4")]
            known = np.unpackbits(np.frombuffer(known, np.uint8))[: len(cells)]
            bucket = (cells >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(cells), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            parts = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(bucket[a]) for a, _ in parts], pa.int64()), pa.array([planes(np.diff(cells[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()),
                    pa.array([planes(numbers[a:b]) for a, b in parts], pa.binary()), pa.array([known[a:b].tobytes() for a, b in parts], pa.binary()),
                ],
                ["bucket", "cells", "ids", "known"],
            )

    def meet(table: pa.Table) -> pa.Table:
        cells = np.concatenate([np.cumsum(from_planes(x, "<u8"), dtype=np.uint64) for x in table.column("cells").to_pylist()])
        ids = np.concatenate([from_planes(x, "<i8") for x in table.column("ids").to_pylist()])
        known = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("known").to_pylist()])
        order = np.argsort(cells, kind="stable")
        cells, new = cells[order], known[order] == 0  # the known ones stand in their profile row
        twice = cells[1:] == cells[:-1]
        several = np.zeros(len(cells), bool)
        several[1:] = twice
        several[:-1] |= twice
        keep = several & new
        return pa.table({"cell": cells[keep].view(np.int64), "id": ids[order][keep]})

    own = profiles.select(F.inline(F.arrays_zip(F.col("shared_cells").alias("cell"), F.col("shared_ids").alias("id")))).toDF("cell", "id")
    with small_batches(profiles.sparkSession, 1):
        dealt = profiles.select("ids", "cells", "places", "known").mapInArrow(deal, "bucket bigint, cells binary, ids binary, known binary")
        return written_table(dealt.groupBy("bucket").applyInArrow(meet, "cell bigint, id bigint").unionByName(own), "jaccard-cells")


def _points(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(id, sig, need, fine, spares) of each text: sig is a digest of the set, fine its counts in ``FINE`` groups as bytes,
    spares the cells of each band that it may leave out. Counts above ``MOST`` are cut; two sets overlap there in at most
    half of what both were cut by, so ``need``, the size, is less by what that is worth in ``_reaches``."""

    spares, percent = pa.list_(pa.struct([("band", pa.int32()), ("spare", pa.int64())])), bands.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in slices(batches):
            rows = [shingles(t, memo, width) for t in batch.column(1).to_pylist()]
            counts = [np.bincount((_mix(h) % np.uint64(FINE)).astype(np.int64), minlength=FINE) for h in rows]
            need = [len(h) + -(100 + percent) * int(np.maximum(c - MOST, 0).sum()) // (2 * percent) for h, c in zip(rows, counts)]
            fine = [np.minimum(c, MOST).astype(np.uint8).tobytes() for c in counts]
            sig = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary()), pa.array(need, pa.int64()), pa.array(fine, pa.binary()), pa.array([bands.spare(h) for h in rows], spares)], ["id", "sig", "need", "fine", "spares"])

    return docs.mapInArrow(run, "id bigint, sig binary, need bigint, fine binary, spares array<struct<band int, spare bigint>>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in slices(batches):
            rows = [shingles(t, memo, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles binary")


def _sizes(occ: DataFrame) -> DataFrame:
    """(cell, members) of the cells that several sets lie in."""
    return occ.groupBy("cell").agg(F.count("*").alias("members")).filter("members > 1")


def _rare(occ: DataFrame, spares: DataFrame) -> DataFrame:
    """Rows (cell, rep, members) without the cells that a set may leave out, the fullest ones. Every linked pair still meets: of
    the cells that it shares, the one with the fewest members has more above it than either set leaves out."""
    part = W.partitionBy("rep", "band").orderBy(F.desc("members"), F.desc("cell"))
    banded = occ.withColumn("band", F.col("cell").bitwiseAND(F.lit(_BANDS).cast("bigint")).cast("int"))
    ranked = banded.withColumn("rank", F.row_number().over(part)).join(spares, ["rep", "band"], "left")
    return ranked.filter("rank > coalesce(spare, 0)").select("cell", "rep", "members")


def _reaches(u: np.ndarray, needs: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
    """Whether the summed smaller coordinates reach the overlap that a link of sets with that sum of sizes needs."""
    return np.minimum(u, v).sum(-1, dtype=np.int64) * (100 + percent) >= percent * needs


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose summed smaller coordinates reach the overlap that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in ("pa", "pb"))
            needs = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(_reaches(u, needs, v, percent)))

    left, right = points.select("id", "need", "fine").toDF("a", "na", "pa"), points.select("id", "need", "fine").toDF("b", "nb", "pb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a bigint, b bigint")


class RTree:
    """Points packed into leaves of ``LEAF`` and leaves into nodes, ordered by size and then by coordinates; a box
    keeps the greatest coordinates and the smallest size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points[:, 1], points[:, 0], sizes))
        strip = max(LEAF, int(len(order) ** 0.5) // LEAF * LEAF)
        for a in range(0, len(order), strip):  # within a strip of like sizes, by the widest coordinate
            part = order[a : a + strip]
            wide = int(np.argmax(np.ptp(points[part], axis=0)))
            order[a : a + strip] = part[np.argsort(points[part, wide], kind="stable")]
        self.order, self.points, self.sizes = order, points, sizes
        self.leaves = [order[a : a + LEAF] for a in range(0, len(order), LEAF)]
        self.high = np.array([points[x].max(0) for x in self.leaves])
        self.small = np.array([sizes[x].min() for x in self.leaves])
        self.nodes = [np.arange(a, min(a + LEAF, len(self.leaves))) for a in range(0, len(self.leaves), LEAF)]
        self.node_high = np.array([self.high[x].max(0) for x in self.nodes])
        self.node_small = np.array([self.small[x].min() for x in self.nodes])

    def join(self, other: RTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (own, other) whose summed smaller coordinates reach the overlap that a link needs."""

        def reaches(high_a, small_a, high_b, small_b):
            return _reaches(high_a, small_a + small_b, high_b, percent)

        for a, leaf in enumerate(self.leaves):
            for node in np.flatnonzero(reaches(self.high[a], self.small[a], other.node_high, other.node_small)):
                kids = other.nodes[node]
                for b in kids[reaches(self.high[a], self.small[a], other.high[kids], other.small[kids])]:
                    theirs = other.leaves[b]
                    near = reaches(self.points[leaf][:, None], self.sizes[leaf][:, None], other.points[theirs][None], other.sizes[theirs][None])
                    i, j = np.nonzero(near)
                    if len(i):
                        yield leaf[i], theirs[j]


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """members: (cell, page_a, page_b, page, id, class, need, fine), grouped and sorted by the first three."""

    def search(rows: pa.RecordBatch, page_a: int, page_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        page, ids, cls, needs = (rows.column(k).to_numpy() for k in (3, 4, 5, 6))
        if len(np.unique(cls)) < 2:
            return
        fine = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(-1, FINE)
        points = fine.reshape(len(fine), -1, GROUPS).sum(1, dtype=np.int64)
        left = np.flatnonzero(page == page_a)
        right = np.flatnonzero(page == page_b)
        if not len(left) or not len(right):
            return
        tree = RTree(points[left], needs[left])
        other = tree if page_a == page_b else RTree(points[right], needs[right])
        for i, j in tree.join(other, percent):
            a, b = left[i], right[j]
            keep = (cls[a] != cls[b]) & ((ids[a] < ids[b]) if page_a == page_b else True)
            a, b = a[keep], b[keep]
            keep = _reaches(fine[a], needs[a] + needs[b], fine[b], percent)
            if keep.any():
                a, b = ids[a[keep]], ids[b[keep]]
                yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        sent: set[tuple[int, int]] = set()

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                for a, b in search(rows, key[1], key[2]):
                    fresh = set(zip(a.tolist(), b.tolist())) - sent
                    if fresh:
                        if len(sent) > SENT:
                            sent.clear()
                        sent.update(fresh)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(fresh))], ["a", "b"])
                held.clear()

        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                if start == stop:
                    continue
                now = tuple(keys[start].tolist())
                if now != key:
                    yield from close()
                    key = now
                held.append(batch.slice(start, stop - start))
        yield from close()

    return members.mapInArrow(run, "a bigint, b bigint")


def _verified(near: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a written table whose exact sets link. They are few, and their texts are known before any set is
    made. A hub's many pairs are a hot key that adaptive execution may split."""
    named = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with small_batches(near.sparkSession):
        sets = written_table(_sets(docs.join(named, "id", "left_semi"), width), "jaccard-sets")
        joined = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        links = written_table(joined.mapInArrow(run, "a bigint, b bigint"), "jaccard-links")
    drop_table(near, sets)
    return links


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key reachable by links of at least ``percent`` similarity.

    A null or empty text, or one without words, has no shingles and no links. Rows that repeat a key
    are one node with all their texts. A null key has a null class. Keys are whole numbers; other
    columns are not read. Texts are used whole.
    """
    bands = Bands(percent)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    with small_batches(docs.sparkSession, 512):
        profiles = written_table(_profiles(rows, width, bands), "jaccard-profiles")
    sizes = written_table(profiles.select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("sizes").alias("n")))).toDF("id", "n"), "jaccard-sizes")
    cells = _shared_cells(profiles)
    drop_table(profiles)

    met = rows.join(cells.select("id").distinct(), "id", "left_semi")
    with small_batches(docs.sparkSession, 512):
        points = written_table(_points(met, width, bands), "jaccard-points")
    first = points.groupBy("sig").agg(F.min("id").alias("rep"))
    copies = written_table(points.select("id", "sig").join(first, "sig").select("id", "rep").distinct(), "jaccard-copies")

    occ = cells.join(copies, "id").select("cell", "rep").distinct()
    met_in = written_table(occ.join(_sizes(occ), "cell"), "jaccard-met")
    drop_table(cells)
    spares = points.join(copies, "id").select("rep", F.inline("spares")).groupBy("rep", "band").agg(F.min("spare").alias("spare")).filter("spare > 0")
    occ = _rare(met_in, spares).select("cell", "rep")
    occ = written_table(occ.join(_sizes(occ), "cell"), "jaccard-members")
    drop_table(met_in)
    central = occ.groupBy("rep").agg(F.sum("members").alias("weight"))
    weighed = occ.join(central, "rep")
    hubs = weighed.groupBy("cell").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    stars = occ.join(hubs, "cell").filter("rep != hub").groupBy("rep", "hub").count()
    stars = stars.groupBy("rep").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    stars = stars.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    with small_batches(docs.sparkSession, 512):
        near = written_table(_bounded(stars, points, percent), "jaccard-stars")
    links = _verified(near, rows, width, percent)

    known = components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("known"))
    classed = written_table(occ.join(known, "rep", "left").select("cell", "rep", "members", F.coalesce("known", "rep").alias("class")), "jaccard-classes")
    drop_table(occ)
    mixed = classed.groupBy("cell").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("cell")
    pages = F.ceil(F.col("members") / PAGE).cast("int")
    spread = classed.join(mixed, "cell").withColumn("pages", pages).withColumn("page", F.pmod(F.xxhash64("rep"), F.col("pages")).cast("int"))
    spread = spread.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    spread = spread.select("cell", F.least("page", "mate").alias("page_a"), F.greatest("page", "mate").alias("page_b"), "page", "rep", "class")
    own = points.join(first, "sig").filter("id = rep").select("rep", "need", "fine").dropDuplicates(["rep", "need", "fine"])
    members = spread.join(own, "rep").select("cell", "page_a", "page_b", "page", F.col("rep").alias("id"), "class", "need", "fine")
    members = members.repartition("cell", "page_a", "page_b").sortWithinPartitions("cell", "page_a", "page_b", "id")
    with small_batches(docs.sparkSession, 512):
        near = written_table(_candidates(members, percent).distinct(), "jaccard-candidates")
    more = _verified(near, rows, width, percent)

    drop_table(classed, points)
    edges = links.unionByName(more).unionByName(copies.filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    found = components(edges, "a", "b")
    out = sizes.join(found, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, with all their columns, that stand for their class; rows without a class stay."""
    gone = classes.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("gone"), "left_anti")
