"""Helpers of the operators: Arrow batches in small slices and bounded memo tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import SparkSession

SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that only a few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_groups(batches: Iterator[pa.RecordBatch], group_bytes: int = 20 << 20) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, texts) of rows in a row, about ``group_bytes`` of text together; a null text is empty. A row is never cut."""
    held, size = [], 0
    for batch in slices(batches):
        texts = pc.fill_null(batch.column(1), "").cast(pa.string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            done = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, done + group_bytes - size)) + 1, len(texts))
            held.append((batch.column(0).slice(at, to - at), texts.slice(at, to - at)))
            size += int(ends[to - 1]) - done
            at = to
            if size >= group_bytes:
                yield tuple(map(pa.concat_arrays, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held)))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 128):
    """Few rows per Arrow batch while eager jobs move whole texts or sets: a batch stands in the JVM, on its way and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Memo(dict):
    """A function's results by key. It is emptied when full, so it stays bounded; long keys are not kept."""

    def __init__(self, function: Callable, prefix: str = "", entries: int = 300_000, longest: int = 64):
        super().__init__()
        self.function, self.prefix, self.entries, self.longest = function, prefix, entries, longest

    def __missing__(self, key: str):
        value = self.function(self.prefix + key if self.prefix else key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


def planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: all lowest bytes first. High bytes are mostly alike, so files and shuffles compress them away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def squeezed(values: np.ndarray) -> bytes:
    """Planes of whole numbers, compressed: for columns that are both written and shuffled."""
    return zstandard.compress(planes(values), 1)


def unsqueezed(raw: bytes, kind: str) -> np.ndarray:
    return from_planes(zstandard.decompress(raw), kind)


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
