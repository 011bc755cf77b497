"""A training-data pipeline over ``documents``: five stages, each an operator of ``tilescope.llm``.

Each stage's rows are written as Parquet and read again as the next one's input.
All but the last return the columns of ``documents``; the last adds the token ids.

Defined results: a null text counts as empty in every stage, and rows with empty
texts are one group of exact copies; texts of any length are whole; of rows that are
repeated, or equal in text, one stays (the longest original, then the smallest
``doc_id``); a row without ``doc_id`` is decided by its text alone; null languages and
sources are values of their own; an empty table, or empty labels, give an empty
result or an unfiltered one; further columns of ``documents``, whatever their names,
come through as they were, and where one is called like a column that the last stage
adds, the added one has underscores behind its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilescope.llm import bpe, exact_dedup, mixing, near_dup, toxicity
from tilescope.llm.common import materialize, scratch, table
from tilescope.llm.queries import tokenizer

#: The mixture takes nine tenths of what is left, by nearly even weights: after
#: deduplication no document is repeated, so it levels sources instead of copying them.
MIX = mixing.Mix(langs={"en": 500, "de": 200, "fr": 150, "es": 150}, budget_permille=900, max_epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mixture(docs, MIX)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

#: Scores, epochs' order and token ids are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before wrote is deleted."""
    with scratch(spark):
        docs = table(spark, sf_dir, "documents")
        for k, (name, stage) in enumerate(STAGES):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", last=k + 1 == len(STAGES))
    return docs
