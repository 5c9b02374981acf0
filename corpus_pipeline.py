"""A training-data pipeline over ``documents``: toxicity, n-gram Jaccard join, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftmill.llm import bpe_codec, decontaminate, ngram_join, toxicity
from siftmill.llm.base import small_batches
from siftmill.session import written_table
from siftmill.sources.tables import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled rows among ``docs`` and drop every row that scores 0.7 or more."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every class of near copies: 0.8 on shingles of five words."""
    return ngram_join.keep_one(docs, ngram_join.jaccard_classes(docs, width=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each),
    ("decontamination", drop_contaminated),
    ("bpe_codec", tokenize),
]

#: No SQL: a learned score, similarity classes and BPE merges are beyond it. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark, 512):
        for name, stage in STAGES[:-1]:
            docs = written_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
