"""Token-id files: ids of all documents in key order, range-coded in checksummed blocks.

A file is a Parquet part whose rows are segments of some million ids: the keys and lengths of
its documents, and the blocks of :mod:`range_coder` behind a header. Parts are written in key
ranges, so the order of all ids is the order of parts, then segments; a part is committed with
its task, so lost executors leave no half files.

Segment bytes: ``SMT2``, block count (u32), then per block: ids, bytes, crc32 (u32 each), then
the blocks' bytes in order. All numbers are little-endian.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.llm.base import slices, text_groups
from siftmill.llm.bpe import BLANK, PieceTable, with_spaces
from siftmill.llm.range_coder import decode_ids, encode_ids

MAGIC = b"SMT2"
SEGMENT_IDS = 1 << 23
JOINED, AT_ONCE = 100, 200  # pieces that the library encodes as one text, texts that it gets at once


class _Encoder(PieceTable):
    """Ids of texts. Texts are cut into pieces that a byte-level tokenizer encodes apart; the library is asked for
    the pieces that are not in the table yet, joined to texts: how many bytes each of its ids stands for tells which are
    a piece's. Other tokenizers are given whole texts."""

    def __init__(self, tokenizer, entries: int = 800_000):
        super().__init__(entries)
        self.tokenizer = tokenizer
        added, pre = tokenizer.get_added_tokens_decoder(), tokenizer.pre_tokenizer
        plain = not any(t.single_word or t.lstrip or t.rstrip or t.normalized or any(map(str.isspace, t.content)) for t in added.values())
        self.cuts = plain and not tokenizer.normalizer and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
        vocab = tokenizer.get_vocab(with_added_tokens=True) if self.cuts else {}
        self.sizes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(token) for token in vocab]  # a letter stands for a byte
        marks = "".join(f"\\x{{{ord(t.content[0]):x}}}" for t in added.values())
        self.joins = rf"^\n?[^{BLANK}{marks}]+$"  # pieces with a special string's first character could spell it

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids: list[np.ndarray] = [np.empty(0, np.uint32)]
        for at in range(0, len(texts), AT_ONCE):
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
        return np.concatenate(ids), np.array([len(x) for x in ids[1:]], np.int64)

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        starts = pa.array([*range(0, len(pieces), JOINED), len(pieces)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(starts, pieces), " ").to_pylist()
        ids, _ = self._alone([f" {t}".replace(" \n", "\n") for t in texts])
        ends = np.cumsum(pc.binary_length(pieces).to_numpy() + 1 - pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False))
        upto = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        stops = np.searchsorted(upto, ends)
        if len(ends) and (stops[-1] != len(ids) or (upto[stops] != ends).any()):
            raise ValueError("the ids of the tokenizer do not stand for the bytes of the text")
        return ids, np.diff(stops, prepend=0)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """The places of new pieces behind the known ones."""
        joins = pc.match_substring_regex(pieces, self.joins)
        others = pieces.filter(pc.invert(joins))
        self._add(pieces.filter(joins), *self._joined(pieces.filter(joins)))
        self._add(others, *self._alone(with_spaces(others)))
        return np.argsort(np.argsort(~joins.to_numpy(zero_copy_only=False), kind="stable"))

    def columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return super().columns(texts) if self.cuts else self._alone(texts.to_pylist())

    def of(self, texts: list[str]) -> list[bytes]:
        ids, lengths = self.columns(pa.array(texts, pa.string()))
        return [part.astype("<u4").tobytes() for part in np.split(ids, np.cumsum(lengths)[:-1])]


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One encoder per worker process, which serves many tasks in turn."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return _Encoder(Tokenizer.from_file(path))


def pack(ids: np.ndarray) -> bytes:
    blocks = encode_ids(ids)
    head = np.array([(n, len(blob), crc) for n, crc, blob in blocks], "<u4").tobytes()
    return MAGIC + struct.pack("<I", len(blocks)) + head + b"".join(blob for *_, blob in blocks)


def unpack(raw: bytes) -> np.ndarray:
    if raw[:4] != MAGIC:
        raise ValueError("not a token segment")
    (count,) = struct.unpack_from("<I", raw, 4)
    table, at, blocks = np.frombuffer(raw, "<u4", count * 3, 8).reshape(count, 3).tolist(), 8 + 12 * count, []
    for n, size, crc in table:
        blocks.append((n, crc, raw[at : at + size]))
        at += size
    return decode_ids(blocks)


def write_files(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts with the tokenizers library, append ``end_id`` to each, write them in key order.

    A null or empty text is just the end id. Null keys come first; rows of one key are ordered by
    text. Other columns are not read. ``tokenizer_path`` must exist on every executor.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        part, number, total = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # keys, lengths and ids of the segment to be

        def segment() -> pa.RecordBatch:
            keys, lengths = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            ids, one = np.concatenate([h[2] for h in held]), pa.array([0, len(keys)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.ListArray.from_arrays(one, keys), pa.ListArray.from_arrays(one, pa.array(lengths)), pa.array([len(ids)], pa.int64()), pa.array([pack(ids)], pa.binary())],
                ["part", "segment", "keys", "lengths", "n_ids", "payload"],
            )

        for keys, texts in text_groups(batches):
            ids, lengths = encoder.columns(texts)
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            lengths = lengths + 1
            stops, at = np.concatenate([[0], np.cumsum(lengths)]), 0
            while at < len(lengths):
                to = min(int(np.searchsorted(stops, stops[at] + segment_ids - total)), len(lengths))
                held.append((keys.slice(at, to - at), lengths[at:to], ids[stops[at] : stops[to]]))
                total += int(stops[to] - stops[at])
                at = to
                if total >= segment_ids:
                    yield segment()
                    held, total, number = [], 0, number + 1
        if held:
            yield segment()

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    rows.mapInArrow(run, f"part int, segment int, keys array<{kind}>, lengths array<bigint>, n_ids bigint, payload binary").write.parquet(path)


def read_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(part, segment, key, place, ids binary) of every document: ids as little-endian 32-bit words, place within its segment."""
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            part, segment, payload = (batch.column(c)[0].as_py() for c in (0, 1, 4))
            keys, stops = batch.column(2).flatten(), np.concatenate([[0], np.cumsum(batch.column(3).flatten().to_numpy())])
            ids = unpack(payload)
            for a in range(0, len(keys), 512):
                b = min(a + 512, len(keys))
                own = [ids[i:j].tobytes() for i, j in zip(stops[a:b], stops[a + 1 : b + 1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (b - a), pa.int32()), pa.array([segment] * (b - a), pa.int32()), keys.slice(a, b - a), pa.array(stops[a:b], pa.int64()), pa.array(own, pa.binary())],
                    ["part", "segment", "k", "place", "ids"],
                )

    out = files.select("part", "segment", "keys", "lengths", "payload").mapInArrow(run, f"part int, segment int, k {kind}, place bigint, ids binary")
    return out.withColumnRenamed("k", key)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, before): ids of all earlier segments. Parts are summed first, so the one ordered step has a row per part."""
    index = spark.read.parquet(path).select("part", "segment", "n_ids", F.col("keys")[0].alias("first_key"))
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min_by("first_key", "segment").alias("first_key"))
    before = Window.orderBy(F.asc_nulls_first("first_key"), "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("parts_before"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = index.select("part", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("own_before"))
    return index.join(parts, "part").select("part", "segment", (F.col("parts_before") + F.col("own_before")).alias("before"))


def digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files."""
    own = read_files(spark, path, key).select("part", "segment", key, "place", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return own.join(offsets(spark, path), ["part", "segment"]).select(key, (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
