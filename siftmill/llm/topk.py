"""Exact top-k by inner product: a KD-tree per shard, best-first traversal with box bounds, and a propagated kth score."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.base import slices

LEAF = 128
SHARD_ROWS = 4096  # rows of a shard, on average
BLOCK_QUERIES = 1024  # rows of a shard that are held or searched at once
EXACT = 1 << 53  # up to here whole numbers are exact as floats
MOST = (1 << 63) - 1


class KDTree:
    """Median splits on the widest side; every node keeps the tight box of its points. Whole numbers: as floats where
    all sums are exact, else as Python's."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.reach = max((abs(int(points.min())), abs(int(points.max()))), default=0) * points.shape[1]
        self.whole, self.points = points, points.astype(np.float64)
        self.low, self.high, self.kids, self.rows = [], [], [], []
        self._build(np.arange(len(points)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, rows: np.ndarray, leaf: int) -> None:
        todo = [(rows, None)]
        while todo:
            rows, parent = todo.pop()
            own, me = self.points[rows], len(self.kids)
            low, high = own.min(0), own.max(0)
            self.low.append(low)
            self.high.append(high)
            self.kids.append([])
            self.rows.append(None)
            if parent is not None:
                self.kids[parent].append(me)
            side = int(np.argmax(high - low))
            if len(rows) <= leaf or high[side] == low[side]:
                self.rows[me] = rows
                continue
            half = len(rows) // 2
            order = np.argpartition(own[:, side], half)
            todo += [(rows[order[:half]], me), (rows[order[half:]], me)]

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, -id) other than ``own`` that reach ``floor``. A box is opened while its bound
        reaches the kth score: at equality it may hold a tie with a smaller id."""
        if max(abs(int(query.min())), abs(int(query.max()))) * self.reach >= EXACT:
            scores = [sum(a * b for a, b in zip(row, query.tolist())) for row in self.whole.tolist()]
            best = heapq.nlargest(k, ((s, -i) for s, i in zip(scores, ids.tolist()) if i != own))
            return [(min(max(s, -MOST), MOST), i) for s, i in best]
        query = query.astype(np.float64)
        bound = np.maximum(self.low * query, self.high * query).sum(1).tolist()
        best: list[tuple[int, int]] = []
        open_boxes = [(-bound[0], 0)]
        while open_boxes:
            b, node = heapq.heappop(open_boxes)
            least = best[0][0] if len(best) == k else floor
            if -b < max(least, floor):
                break
            rows = self.rows[node]
            if rows is None:
                for kid in self.kids[node]:
                    heapq.heappush(open_boxes, (-bound[kid], kid))
                continue
            scores = self.points[rows] @ query
            for at in np.flatnonzero(scores >= max(least, floor)).tolist():
                entry = (int(scores[at]), -int(ids[rows[at]]))
                if entry[1] == -own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return best


def quantized(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(key, v array<bigint>): floor(scale * x) of each component. Null vectors and vectors with a null or non-finite component go, and so do null keys, empty vectors and those
    with a component whose whole number leaves 64 bits."""
    small = lambda x: F.abs(x.cast("double") * scale) < 2.0**63
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & small(x))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(key).alias(key), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, key, score): for each query the k highest inner products with other rows, ties to the smaller key.

    Both sides hold (key, v); only vectors of one length are compared. Keys must be whole numbers;
    a query never meets its own key. Of query rows that repeat a key the least vector asks, once;
    repeated candidate rows each take a rank. Scores are exact; those that leave 64 bits are the
    greatest or least number of 64 bits. Candidates are dealt into shards by hash; a shard's tree is
    built once, then its queries stream by. First every query visits one shard; its kth score there is
    then the floor in all others. Empty sides give no rows.
    """
    shards = max(1, -(-candidates.count() // shard_rows))
    shard = F.pmod(F.xxhash64(key, "v"), F.lit(shards)).cast("int")
    left = candidates.select(F.col(key).alias("id"), F.col("v").alias("v"), shard.alias("shard"))
    right = queries.groupBy(F.col(key).alias("id")).agg(F.min("v").alias("v"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, asks, id, v, floor) by shard, its candidates before its queries: one tree per shard and length of
        vectors; queries pass it in batches."""
        shard, held, trees = None, [], None

        def built() -> dict[int, tuple[KDTree, np.ndarray]]:
            by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
            for key, v in sorted(held, key=lambda row: row[0]):
                by_size.setdefault(len(v), []).append((key, v))
            return {size: (KDTree(np.stack([v for _, v in own])), np.array([key for key, _ in own])) for size, own in by_size.items()}

        for batch in slices(batches, block_queries):
            numbers, asks, ids, floors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "id", "floor"))
            vectors, found = batch.column("v"), []
            stops, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            for at in range(batch.num_rows):
                v = flat[stops[at] : stops[at + 1]]
                if numbers[at] != shard:
                    shard, held, trees = numbers[at], [], None
                if not asks[at]:
                    held.append((ids[at], v.copy()))
                    continue
                trees = built() if trees is None else trees
                if len(v) in trees:
                    tree, own = trees[len(v)]
                    found += [(ids[at], -minus, score) for score, minus in tree.search(v, k, own, ids[at], floors[at])]
            columns = [pa.array([row[c] for row in found], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])

    ddl = "query_id bigint, id bigint, score bigint"

    def visit(asked: DataFrame) -> DataFrame:
        """asked: id, v, shard, floor. Every shard is sent once, whatever the number of queries."""
        rows = left.select("shard", F.lit(False).alias("asks"), "id", "v", F.lit(0.0).alias("floor"))
        rows = rows.unionByName(asked.select("shard", F.lit(True).alias("asks"), "id", "v", "floor"))
        return rows.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(search, ddl)

    low = float("-inf")
    home = right.withColumn("shard", F.pmod("id", F.lit(shards)).cast("int")).withColumn("floor", F.lit(low))
    first = visit(home)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    asked = home.drop("floor").withColumnRenamed("shard", "home").join(kth, F.col("id") == F.col("query_id"), "left")
    asked = asked.withColumn("floor", F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(F.lit(low)))
    rest = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard != home").select(F.col("id").alias("id"), F.col("v").alias("v"), "shard", "floor")
    both = first.unionByName(visit(rest)) if shards > 1 else first
    ranked = both.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
