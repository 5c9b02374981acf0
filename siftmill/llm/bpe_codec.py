"""Byte-level BPE encoding and decoding of whole texts with a rank file.

Merges run on segment trees over byte positions (``bpe.Merger``), for all new words of a group of texts. Encoding and decoding
are narrow maps: a document never leaves its task and no shuffle happens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.base import slices, text_groups
from siftmill.llm.bpe import Merger, PieceTable, read_ranks, splitter

GROUP_BYTES = 2 << 20  # of texts whose pieces are numbered at once
WORDS, LONGEST = 150_000, 64  # words whose ids are kept, and their letters


class _Encoder(PieceTable):
    """Made anew by every task: kept from task to task, its tables would take memory from later jobs."""

    def __init__(self, ranks_path: str, pattern: str, entries: int = 400_000):
        super().__init__(entries)
        self.split, self.merger = splitter(pattern), Merger(read_ranks(ranks_path))
        self.words: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.split(t) for t in texts]
        wanted = set().union(*lists)
        if len(self.words) + len(wanted) > WORDS:
            self.words = {}
        new = [w for w in wanted if w not in self.words]
        self.words.update(zip(new, self.merger.of([w.encode() for w in new])))
        parts = [b"".join(map(self.words.__getitem__, words)) for words in lists]
        for w in new:
            if len(w) > LONGEST:
                del self.words[w]
        return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row, as the rank file's library would give without special tokens.

    A null or empty text has no ids. Repeated rows and null keys are kept as they are; other
    columns are not read. Long texts are encoded whole. ``ranks_path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(ranks_path, pattern)
        for keys, texts in text_groups(batches, GROUP_BYTES):
            ids, lengths = encoder.columns(texts)
            offsets = pa.array(np.cumsum([0, *lengths]), pa.int32())
            encoded = pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))], ["k", "ids"])
            yield from slices(iter([encoded]))
        pa.default_memory_pool().release_unused()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded binary): the bytes that the ids stand for. Null ids decode to null; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {rank: token for token, rank in read_ranks(ranks_path).items()}
        spelled = pa.array([ranks.get(rank) for rank in range(max(ranks, default=-1) + 1)], pa.binary())
        for batch in slices(batches):
            col = batch.column(1)
            tokens = spelled.take(col.flatten())
            if tokens.null_count:
                raise ValueError("an id is none of the ranks")
            places = np.cumsum([0, *pc.fill_null(pc.list_value_length(col), 0).to_pylist()])
            ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset :][places]
            out = pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(ends.tobytes()), tokens.buffers()[2]])
            yield pa.RecordBatch.from_arrays([batch.column(0), col, pc.if_else(col.is_valid(), out, None)], ["k", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInArrow(run, f"k {kind}, ids array<int>, decoded binary").withColumnRenamed("k", key)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(
        key,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
