"""The corpus pipeline: quality filter, near-duplicates, personal data, source mixing, tokens.

What a stage keeps is written as Parquet, and the next one reads that and nothing else of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import bpe, mixing, pii, quality, simhash
from tidewell.llm.common import load, settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts.

    A null text counts as empty, null sources and languages are sites of their own, repeated rows are judged each, further
    columns stay; an empty table stays empty, and without labels every document stays.
    """
    return quality.accepted(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Rows with a null id or text stay; of rows that repeat an id and its text one stays; texts without words are copies
    only if they are equal; further columns stay; an empty table stays empty.
    """
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked in their whole texts, and n_chars brought up to date.

    Null and empty texts, repeated rows and further columns stay as they are; an empty table stays empty.
    """
    return pii.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its source's target asks for.

    A null source is one like any other, null ids come first in theirs, repeated rows count each, further columns stay; an
    empty table stays empty.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and character offsets of every document that is left, each copy of it, and whether decoding gives it back.

    A null text has nulls, an empty one no tokens; repeated rows and null ids give rows of their own; an empty table none.
    """
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express the SimHash, PII and BPE stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's result isn't written here."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
