"""Stupid-backoff language-model scores of every document under counts of all the others.

Documents are packed into blocks of about a million words, one row each. A block asks once for
every distinct word and word pair that it holds: requests are dealt by hash of the n-gram into
buckets, which hold the count table; each bucket sums its requests and answers them; answers join
their block, are taken down to word positions, and are summed per document. A word that a third of
the documents hold is one request per block, so no bucket is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.base import Memo, from_planes, planes, slices, small_batches, squeezed, unsqueezed
from siftmill.llm.ngram_join import _mix
from siftmill.session import written_table

BACKOFF = 0.4
BLOCK_WORDS = 1 << 20
BUCKET_GRAMS = 1 << 20  # requested n-grams per bucket, on average
_M = np.uint64(0x9E3779B97F4A7C15)


def _blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """(block, keys, lengths, vocab, words): words are places in the block's sorted distinct word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little"), entries=200_000)
        block = TaskContext.get().partitionId() << 32
        keys: list = []
        parts: list[np.ndarray] = []
        total = 0

        def row() -> pa.RecordBatch:
            vocab, words = np.unique(np.concatenate(parts), return_inverse=True)
            cols = [[block], [keys], [list(map(len, parts))], [squeezed(np.diff(vocab, prepend=np.uint64(0)))], [squeezed(words.astype("<u4"))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["block", "keys", "lengths", "vocab", "words"])

        for batch in slices(batches):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = t.lower().split() if t else []
                keys.append(k)
                parts.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
                total += len(words)
                if total >= block_words:
                    yield row()
                    block, keys, parts, total = block + 1, [], [], 0
        if keys:
            yield row()

    return docs.mapInArrow(run, "block bigint, keys array<bigint>, lengths array<bigint>, vocab binary, words binary")


class _Block:
    """Positions, distinct n-grams and their places, the same in asking and in scoring."""

    def __init__(self, lengths: list[int], vocab: bytes, words: bytes):
        self.vocab = np.cumsum(unsqueezed(vocab, "<u8"), dtype=np.uint64)
        self.words = unsqueezed(words, "<u4").astype(np.int32)
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.lengths = np.array(lengths, np.int64)
        self.inner = (np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1).astype(np.int32)  # positions with a word before them
        one = _mix(self.vocab + np.uint64(1))
        two = _mix(self.vocab[self.words[self.inner - 1]] * _M + self.vocab[self.words[self.inner]])
        pairs, at, pair_counts = np.unique(two, return_inverse=True, return_counts=True)
        self.pair_at = at.astype(np.int32)
        del two, at
        grams = np.concatenate([one, pairs])
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.counts = np.concatenate([np.bincount(self.words, minlength=len(one)), pair_counts])[order].astype("<u4")
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)

    def own(self, at: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
        """How often each position's n-gram occurs in its own document."""
        _, place, counts = np.unique(doc.astype(np.int64) * size + at, return_inverse=True, return_counts=True)
        return counts[place]

    def score(self, totals: np.ndarray, n: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
        """Log probability and backed-off words per document."""
        one, two = totals[self.place[: len(self.vocab)]], totals[self.place[len(self.vocab) :]]
        rest = np.maximum(n - self.lengths, 1)[self.doc]
        uni = one[self.words] - self.own(self.words, self.doc, len(self.vocab))
        log_uni = np.log(np.where(uni > 0, uni, backoff) / rest)  # a word of no other document: a share of one occurrence
        value, backed = log_uni.copy(), np.zeros(len(self.words), bool)
        if len(self.inner):
            seen = two[self.pair_at] - self.own(self.pair_at, self.doc[self.inner], len(two))
            context = np.maximum(uni[self.inner - 1], 1)
            hit = seen > 0
            value[self.inner] = np.where(hit, np.log(np.where(hit, seen, 1) / context), np.log(backoff) + log_uni[self.inner])
            backed[self.inner] = ~hit
        size = len(self.lengths)
        return np.bincount(self.doc, value, size), np.bincount(self.doc, backed, size)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", backoff: float = BACKOFF, block_words: int = BLOCK_WORDS, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """(key, n_words, n_backed_off, log_prob, mean_log_prob) of every row.

    Words are lower-cased and cut at blanks. A word's score is c(pair) / c(word before), counted in
    all other documents; a pair that no other holds backs off to ``backoff`` times the word's share.
    Whole numbers are taken as keys; null keys and repeated rows are scored like any other (a repeat
    is another document). Null and empty texts have no words, log_prob 0 and a null mean.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    with small_batches(docs.sparkSession, 512):
        blocks = written_table(_blocks(rows, block_words), "lm-blocks")
    n = blocks.agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n")).first()["n"] or 0
    bits = max(0, (2 * n // bucket_grams)).bit_length()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            block = _Block(batch.column(1)[0].as_py(), batch.column(2)[0].as_py(), batch.column(3)[0].as_py())
            bucket = (block.grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(block.grams), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])]), batch.column(0), pa.array([planes(np.diff(block.grams[a:b], prepend=np.uint64(0)))]), pa.array([planes(block.counts[a:b])])], ["bucket", "block", "grams", "counts"])

    def count(table: pa.Table) -> pa.Table:
        grams = [np.cumsum(from_planes(x, "<u8"), dtype=np.uint64) for x in table.column("grams").to_pylist()]
        counts = np.concatenate([from_planes(x, "<u4") for x in table.column("counts").to_pylist()])
        stops = np.cumsum([len(g) for g in grams])[:-1]
        distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
        del grams
        totals = np.bincount(place, counts, len(distinct)).astype("<u8")[place]
        del distinct, place, counts
        answers = np.split(totals, stops)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array([planes(a) for a in answers], pa.binary())})

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys, lengths, vocab, words, answers = (c[0].as_py() for c in batch.columns)
            totals = np.concatenate([from_planes(a["totals"], "<u8") for a in answers or []] or [np.empty(0, "<u8")]).astype(np.int64)
            log_prob, backed = _Block(lengths, vocab, words).score(totals, n, backoff)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lengths, pa.int64()), pa.array(backed.astype(np.int64)), pa.array(log_prob)], ["k", "n_words", "n_backed_off", "log_prob"])

    with small_batches(docs.sparkSession, 1):
        asked = blocks.select("block", "lengths", "vocab", "words").mapInArrow(ask, "bucket bigint, block bigint, grams binary, counts binary")
        answers = asked.groupBy("bucket").applyInArrow(count, "block bigint, bucket bigint, totals binary")
        answers = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias("answers"))
        full = blocks.join(answers, "block", "left").select("keys", "lengths", "vocab", "words", "answers")
        scored = written_table(full.mapInArrow(take, "k bigint, n_words bigint, n_backed_off bigint, log_prob double"), "lm-scores")
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return scored.select(F.col("k").alias(key), "n_words", "n_backed_off", "log_prob", mean.alias("mean_log_prob"))
