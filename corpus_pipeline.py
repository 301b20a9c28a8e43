"""A corpus pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns documents;
the last returns the digests of the written tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from closebook.llm import decontaminate, mixing, ngram_join, tokens, toxicity
from closebook.llm.queries import REPETITIONS, table, tokenizer_path
from closebook.session import small_batches_from_now, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by terms learned from the labels outside the held-out fold."""
    small_batches_from_now(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word n-grams of a similarity of 0.8 or more."""
    return ngram_join.one_of_each_group(docs, percent=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    small_batches_from_now(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of smaller sources again, up to the limit of repetitions."""
    return mixing.mixed(docs, repetitions=REPETITIONS).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts as packed blocks, read back."""
    return tokens.token_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_binary", write_tokens),
]

#: The tokenizer and the fitted scores are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
