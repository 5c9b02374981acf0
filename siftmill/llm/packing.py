"""Packing documents into sequences of a fixed number of tokens, with as few sequences as can be.

1. *Cutting.* A narrow map encodes whole texts and cuts them; every task numbers its pieces of one
   length, so a piece is known by (task, length, place). The pieces are written once, with their ids.
2. *Plan.* A packing depends on the number of pieces of each length only: at most ``limit`` rows,
   whatever the input, come to the driver. The longest length left opens a sequence. Its gap is
   looked up as an exact sum: a length that is it, a pair, a triple, under the numbers that are left;
   where there is none, the longest length that fits goes in (best fit) and the smaller gap is looked
   up again. The pattern is used as often as its lengths allow at once, so patterns are few.
3. *Placing.* Numbers of earlier tasks' pieces of a length give every piece its rank among all of
   its length; the plan maps ranges of ranks to sequences. Pieces are not sorted or grouped, so a
   length that a third of all pieces share is no hot key.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.base import slices
from siftmill.session import written_table

LIMIT = 4096

# ---------------------------------------------------------------- ids of texts

# The normaliser and the pre-tokenizer's pattern of word-end vocabularies whose words can be looked up.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

WORD_END = "</w>"

SIMPLE = re.compile(r"[\n!-;=-~À-ÖØ-öø-ÿ]+\Z")  # characters that normalising only lower-cases, without the one that opens special strings
SIMPLE_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-z0-9ß-öø-ÿ]+")  # the pattern for lower-cased simple words
JOINED = 2000  # parts that the library encodes as one text


class WordEncoder:
    """Ids of texts as little-endian 32-bit words, as the tokenizers library gives them without special tokens.

    A vocabulary of lower-cased words drops white space, so the ids of a text are those of its words
    in turn. Words are kept in a table that is emptied when full. New words of simple characters are cut
    by the pattern into parts, which repeat more; the library encodes the new parts in one text, and
    the ids that end a word tell them apart. Other words, and all texts of other tokenizers, are encoded alone.
    """

    def __init__(self, path: str, entries: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        self.library, self.entries = Tokenizer.from_file(path), entries
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        marks = [t for t in spec["added_tokens"] if t["special"] and t["content"][:1] == "<" and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        self.by_words = (
            (spec["normalizer"] or {}).get("normalizers") == WORD_NORMALIZERS
            and splits[0].get("pattern") == {"Regex": WORD_PATTERN}
            and len(marks) == len(spec["added_tokens"])
            and spec["model"].get("end_of_word_suffix") == WORD_END
        )
        if self.by_words:  # the last id of a part, and no other, ends a word
            vocab = spec["model"]["vocab"]
            self.ends = np.zeros(max(self.library.get_vocab(with_added_tokens=True).values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, missing: list[str]) -> None:
        for at in range(0, len(missing), JOINED):
            part = missing[at : at + JOINED]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(part):
                raw = ids.tobytes()
                self.parts.update(zip(part, [raw[4 * i : 4 * j] for i, j in zip([0, *stops], stops)]))
            else:
                self.parts.update(zip(part, self._alone(part)))

    def _learn(self, words: Iterable[str]) -> None:
        words = list(words)
        if len(self.words) + len(words) > self.entries:
            self.words = {"": b""}
        if len(self.parts) > self.entries:
            self.parts = {}
        simple, known = [w for w in words if w not in self.words], self.parts
        if not SIMPLE.match(text := "\n".join(simple)):
            others = [w for w in simple if not SIMPLE.match(w)]
            self.words.update(zip(others, self._alone(others)))
            simple = [w for w in simple if w not in self.words]
            text = "\n".join(simple)
        pieces = SIMPLE_PARTS.findall(text.lower())
        self._learn_parts([p for p in set(pieces) if p not in known and p != "\n"])
        own: list[bytes] = []
        found = iter(simple)
        for piece in pieces:
            if piece == "\n":
                self.words[next(found)] = own[0] if len(own) == 1 else b"".join(own)
                own = []
            else:
                own.append(known[piece])
        if own:
            self.words[next(found)] = b"".join(own)

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._alone(texts)
        words = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.words
        held = set().union(*words)
        wanted = [w for w in held if w not in known]
        if wanted:
            self._learn(wanted if len(known) + len(wanted) <= self.entries else held)
        get = self.words.__getitem__
        return [b"".join(map(get, own)) for own in words]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder per worker process, which serves many tasks in turn."""
    return WordEncoder(path)


def cut(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(task, place, key, piece, start, length, ids binary): pieces of at most ``limit`` ids of every row.

    A row is one document: whole text, then ``end_id``; a null or empty text is just the end id. Only
    documents of more than ``limit`` ids are cut, every ``limit`` ids. ``place`` counts the task's
    pieces of that length. Repeated rows and null keys are documents of their own.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        for batch in slices(batches, 256):
            source, piece, start, length, place, parts = [], [], [], [], [], []
            for row, raw in enumerate(encoder.of([t or "" for t in batch.column(1).to_pylist()])):
                raw += end
                for number, at in enumerate(range(0, len(raw), 4 * limit)):
                    part = raw[at : at + 4 * limit]
                    n = len(part) // 4
                    source.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(n)
                    place.append(seen[n])
                    parts.append(part)
                    seen[n] += 1
            columns = [pa.array([task] * len(parts), pa.int32()), pa.array(place, pa.int64()), batch.column(0).take(pa.array(source, pa.int32())), pa.array(piece, pa.int32())]
            columns += [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["task", "place", "k", "piece", "start", "length", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = rows.mapInArrow(run, f"task int, place bigint, k {kind}, piece int, start bigint, length bigint, ids binary")
    return out.withColumnRenamed("k", key)


# ---------------------------------------------------------------- plan


class Complements:
    """Numbers of pieces left by length, and exact sums of one, two or three of them.

    Sums are kept in hash tables, found once and used while their lengths last. Numbers only fall,
    so a sum that no pair or triple gives any more is never looked for again.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self.pairs: dict[int, tuple[int, ...] | None] = {}
        self.triples: dict[int, tuple[int, ...] | None] = {}

    def holds(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def longest(self, upto: int) -> int:
        """The longest length left that is at most ``upto``, 0 without one."""
        some = np.flatnonzero(self.left[1 : upto + 1])
        return int(some[-1]) + 1 if len(some) else 0

    def pair(self, total: int, most: int | None = None) -> tuple[int, ...] | None:
        """Two lengths of that sum, the longer as long as can be (at most ``most``)."""
        if most is None:
            known = self.pairs.get(total, ())
            if known is None or known and self.holds(known):
                return known
        low, high = (total + 1) // 2, min(total - 1, len(self.left) - 1, most or total)
        found = None
        if low <= high:
            both = (self.left[low : high + 1] > 0) & (self.left[total - high : total - low + 1][::-1] > 0)
            if 2 * low == total and self.left[low] < 2:
                both[0] = False
            at = np.flatnonzero(both)
            if len(at):
                found = (low + int(at[-1]), total - low - int(at[-1]))
        if most is None:
            self.pairs[total] = found
        return found

    def triple(self, total: int) -> tuple[int, ...] | None:
        """Three lengths of that sum, the longest as long as can be."""
        known = self.triples.get(total, ())
        if known is None or known and self.holds(known):
            return known
        found = None
        top = self.longest(min(total - 2, len(self.left) - 1)) if total > 2 else 0
        for a in reversed((np.flatnonzero(self.left[1 : top + 1]) + 1).tolist()):
            if 3 * a < total:
                break
            self.left[a] -= 1
            rest = self.pair(total - a, most=a)
            self.left[a] += 1
            if rest:
                found = (a, *rest)
                break
        self.triples[total] = found
        return found

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if gap < len(self.left) and self.left[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset), by length and rank: pieces of that length and of ranks
    from the first on lie at ``offset`` in sequences that are numbered on from the first."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, rank, rows, sequence = Complements(left), np.zeros(limit + 1, np.int64), [], 0
    while longest := sums.longest(limit):
        pattern, gap = [longest], limit - longest
        left[longest] -= 1
        while gap:
            most = sums.longest(gap)
            if not most:
                break
            if gap > 3 * most:  # no sum of three gets there yet
                filling = (most,) * int(min(left[most], -(-(gap - 3 * most) // most)))
            else:
                filling = sums.exact(gap) or (most,)
            for x in filling:
                left[x] -= 1
            pattern += filling
            gap -= sum(filling)
        used: dict[int, int] = {}
        for x in pattern:
            used[x] = used.get(x, 0) + 1
        times = 1 + min(int(left[x]) // n for x, n in used.items())
        offset = 0
        for x in pattern:
            rows.append((x, int(rank[x]), times, sequence, offset))
            rank[x] += times
            offset += x
        for x, n in used.items():
            left[x] -= n * (times - 1)
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- placing


def place(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows of ``cut`` (written, so that places hold) without task and place, with sequence_id and offset."""
    held = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    rows = plan(counts, limit)
    keys = rows[:, 0] << 48 | rows[:, 1]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = held.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(earlier, ["task", "length"]).withColumn("rank", F.col("earlier") + F.col("place")).drop("task", "place", "earlier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            own = rows[at]
            columns = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], [*names, "sequence_id", "offset"])

    schema = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids, sequence_id, offset) of every piece, its ids included."""
    return place(written_table(cut(docs, tokenizer_path, limit, end_id, key, text), "pieces"), limit)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, n_tokens, ids binary, pieces): the ids of every sequence, and which piece lies where. A sequence holds
    at most ``limit`` ids, so its group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.struct(key, "piece", "length").alias("of"), "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda got, p: F.concat(got, p["ids"]))
    return out.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["of"][key].alias(key), p["of"]["piece"].alias("piece"), p["of"]["length"].alias("length"))).alias("pieces"))
