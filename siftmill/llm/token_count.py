"""Token counts of whole texts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.base import Memo, slices
from siftmill.llm.bpe import MergeTable, Pieces, splitter


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, a narrow map.

    Special strings in a text count as one token each, as the library has it by default. A null
    or empty text has no bytes and no tokens. Repeated rows and null keys stay; other columns are
    not read. ``tokenizer_path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split = MergeTable(tokenizer_path), splitter(pattern)
        word = Memo(lambda w: table.count(w.encode()), entries=500_000)
        special = re.compile("|".join(map(re.escape, sorted(table.special, key=len, reverse=True))) or r"(?!)")

        def piece(p: str) -> int:
            parts = special.split(p)
            return sum([word[w] for part in parts for w in split(part)]) + len(parts) - 1

        counts = Pieces(piece)
        for batch in slices(batches):
            texts = batch.column(1)
            tokens = [sum(counts.of(t)) if t else 0 for t in texts.to_pylist()]
            size = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens, pa.int64())], ["k", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
