"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme values.

1. Tokens are lower-cased words and word beginnings. Their log-odds between toxic and clean
   training rows carry an informative Dirichlet prior: the counts of both classes together.
2. Each word of a text scores its log-odds, less a drift that makes clean text negative. One
   linear scan finds all maximal segments with a positive score.
3. The best segment of a clean text of n words follows an extreme-value law whose location grows
   with log n. Each segment's p-value under that law becomes bits of evidence; the bits of all
   significant segments are summed and mapped to a probability on the training rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.base import Memo, slices

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)  # letters of word beginnings; the mark ^ tells them from words
LEAST_Z = 2.5  # |z| from which a token's log-odds are kept
DRIFT = 0.5  # taken from every word's log-odds, so that a run of unmarked words ends a passage
SIGNIFICANT = 3.0  # bits from which a segment counts as a passage


def features(word: str) -> tuple[str, ...]:
    return (word, *["^" + word[:n] for n in PREFIXES if len(word) >= n])


@dataclass(frozen=True)
class Model:
    """All that scoring needs. ``odds`` is bounded by ``tokens`` of :func:`train`."""

    odds: dict[str, float]
    location: float
    scale: float
    slope: float
    offset: float

    def word(self, word: str) -> float:
        return max([self.odds[f] for f in features(word) if f in self.odds], key=abs, default=0.0)

    def scores(self, words: list[str], odds: Memo) -> list[float]:
        """Each word's log-odds less the drift. The nth repeat of a word in a text adds an nth, so a repeated line is no passage by itself."""
        out, seen = [], {}
        for w in words:
            v = odds[w]
            if v > 0:
                seen[w] = n = seen.get(w, 0) + 1
                v /= n
            out.append(v - DRIFT)
        return out


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint and in order, in linear time (Ruzzo and Tompa)."""
    found: list[list] = []  # start, end, sum before, sum through, nearest earlier candidate with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(rows: DataFrame, tokens: int = 150_000) -> DataFrame:
    """(token, bad, good) from (text, toxic): occurrences by class, summed in tasks before the shuffle, some ``tokens`` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list[int]] = {}
        split = Memo(features, entries=100_000)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([v[1] for v in tally.values()], pa.int64()), pa.array([v[0] for v in tally.values()], pa.int64())], ["token", "bad", "good"])
            tally.clear()
            return out

        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in WORD.findall(text.lower()):
                    for f in split[w]:
                        c = tally.get(f)
                        if c is None:
                            c = tally[f] = [0, 0]
                        c[toxic] += 1
            if len(tally) > tokens:
                yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(run, "token string, bad bigint, good bigint").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", tokens: int = 20_000, least: int = 5, rows: int = 30_000) -> Model:
    """Fit on labelled rows that are not held out; labels join on ``key``.

    ``rows`` bounds the training sample (the rows with the smallest hash of the key; all, where
    fewer are labelled) and ``tokens`` the model (largest |z|). Null texts and labels do not train;
    without rows of both classes the model scores every text alike, below one half.
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1)).groupBy("k").agg(F.max("toxic").alias("toxic"))
    marked = marked.filter(~held_out("k")).orderBy(F.xxhash64("k"), "k").limit(rows)
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(marked), "k")  # at most ``rows`` rows
    counts = _counts(picked).filter(F.col("bad") + F.col("good") >= least)
    totals = picked.groupBy("toxic").count().collect()
    counted = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    n1, n0 = counted["bad"] or 0, counted["good"] or 0
    if len(totals) < 2 or not n1 or not n0:
        return Model({}, 0.0, 1.0, 0.0, -1.0)
    prior, both = 500.0, n1 + n0
    a = F.lit(prior) * (F.col("bad") + F.col("good")) / both + 0.5
    odds = F.log((F.col("bad") + a) / (n1 + prior - F.col("bad") - a)) - F.log((F.col("good") + a) / (n0 + prior - F.col("good") - a))
    z = odds / F.sqrt(1 / (F.col("bad") + a) + 1 / (F.col("good") + a))
    top = counts.select("token", odds.alias("odds"), z.alias("z")).orderBy(F.desc(F.abs("z")), "token").limit(tokens)
    model = {r["token"]: float(r["odds"]) for r in top.filter(F.abs("z") >= LEAST_Z).collect()}
    plain = Model(model, 0.0, 1.0, 1.0, 0.0)
    best = _scan(picked.select(F.col("toxic").alias("k"), "text"), plain, raw=True)
    # method of moments for the law of clean rows, on best - log n
    clean = best.filter("k = 0").agg(F.avg("excess").alias("m"), F.stddev("excess").alias("s")).first()
    scale = max(0.05, (clean["s"] or 1.0) * math.sqrt(6) / math.pi)
    location = (clean["m"] or 0.0) - 0.5772156649 * scale
    law = Model(model, location, scale, 1.0, 0.0)
    bins = _scan(picked.select(F.col("toxic").alias("k"), "text"), law).select("k", F.round(F.least("bits", F.lit(100.0)), 1).alias("bits")).groupBy("k", "bits").count().collect()
    x = np.array([r["bits"] for r in bins])
    y = np.array([r["k"] for r in bins], float)
    w = np.array([r["count"] for r in bins], float)
    slope, offset = _logistic(x, y, w)
    return Model(model, location, scale, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve through weighted points, by Newton's method. The ridge keeps both finite; a step
    that does not lower the loss is halved, so any number of rows converges."""
    beta, design, pull = np.zeros(2), np.column_stack([x, np.ones_like(x)]), np.array([ridge, 1e-3])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((w * (np.logaddexp(0.0, z) - y * z)).sum() + (pull * b * b).sum() / 2)

    now = loss(beta)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        hess = design.T @ (design * (w * p * (1 - p))[:, None]) + np.diag(pull)
        step = np.linalg.solve(hess, design.T @ (w * (y - p)) - pull * beta)
        part = 1.0
        while part > 1e-10 and loss(beta + part * step) > now - 1e-12 * abs(now):
            part /= 2
        if part <= 1e-10:
            break
        beta = beta + part * step
        now = loss(beta)
    return float(max(0.0, beta[0])), float(beta[1])


def _evidence(score: float, n: int, model: Model) -> float:
    """Bits against the extreme-value law: -log2 of the chance that clean text of ``n`` words has a segment this good."""
    u = (score - math.log(max(n, 2)) - model.location) / model.scale
    e = math.exp(-min(max(u, -30.0), 700.0))
    return -math.log2(-math.expm1(-e)) if e > 1e-9 else min(u, 700.0) / math.log(2)


def _scan(rows: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    """rows: (k, text). (k, bits, excess, passages): summed evidence, best score less log n, and the significant passages."""
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = Memo(model.word, entries=200_000)
        passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("bits", pa.float64())])
        for batch in slices(batches):
            bits, excess, passages = [], [], []
            for text in batch.column(1).to_pylist():
                words = WORD.findall((text or "").lower())
                found = segments(model.scores(words, value))
                best = max((s for *_, s in found), default=0.0)
                excess.append(best - math.log(max(len(words), 2)))
                judged = [] if raw else [(a, b, s, _evidence(s, len(words), model)) for a, b, s in found]
                good = [j for j in judged if j[3] >= SIGNIFICANT]
                bits.append(sum(j[3] for j in good) or max((j[3] for j in judged), default=0.0))
                passages.append([{"start": a, "end": b, "score": s, "bits": e} for a, b, s, e in good])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.float64()), pa.array(excess, pa.float64()), pa.array(passages, pa.list_(passage))], ["k", "bits", "excess", "passages"])

    return rows.mapInArrow(run, f"k {kind}, bits double, excess double, passages array<struct<start:int,end:int,score:double,bits:double>>")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(key, score, predicted, passages) of every row, a narrow map.

    Passages are word ranges of the text with their score and bits. Null and empty texts have no
    passage and the score of no evidence; repeated rows and null keys stay.
    """
    found = _scan(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), model)
    p = 1 / (1 + F.exp(-(F.col("bits") * model.slope + model.offset)))
    return found.select(F.col("k").alias(key), p.alias("score"), (p >= threshold).cast("int").alias("predicted"), "passages")


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` with all their columns whose score stays below ``threshold``; no join, so keys may repeat or be null."""
    need = (math.log(threshold / (1 - threshold)) - model.offset) / model.slope if model.slope > 0 else math.inf
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, at = Memo(model.word, entries=200_000), columns.index(text)
        for batch in slices(batches):
            keep = []
            for t in batch.column(at).to_pylist():
                words = WORD.findall((t or "").lower())
                judged = [_evidence(s, len(words), model) for *_, s in segments(model.scores(words, value))]
                bits = sum(b for b in judged if b >= SIGNIFICANT) or max(judged, default=0.0)
                keep.append(bits < need)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
