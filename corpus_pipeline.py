"""From documents to token ids: STAGES in order, each over all that the stage before kept.

Each function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Rows go by their doc_id and text, so that a repeated doc_id loses no other
text, and rows without a doc_id are treated like others; the operators' docstrings say what nulls, empty and very long texts, ties,
repeated rows and empty tables give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import exact_dedup, mixing, ngram_join, spiece, toxicity
from marlstone.llm.common import temporary, written
from marlstone.llm.queries import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.acceptable(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spiece.encoded(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("source_mixing", mixed_sources),
    ("sentencepiece", token_ids),
]

#: The stages of a trained classifier and of a BPE encoder have no form in SQL; tests/llm/test_pipeline.py holds run() against a plain pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with temporary(spark) as last:
        for _, stage in STAGES[:-1]:
            with temporary(spark) as keep:
                docs = keep(written(stage(spark, docs, sf_dir)))
        last(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
