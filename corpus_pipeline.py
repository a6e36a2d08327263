"""From raw documents to packed token sequences: quality rules, classifier, line dedup, near duplicates, packing.

Every stage but the last returns the columns of documents; what a stage drops is gone for the next ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusops.llm import harmonic_packing, line_dedup, mil_classifier, quality_rules, simhash_dedup
from corpusops.llm.common import made, materialise, release, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, against references from these documents.

    Null and empty texts have too few words and go; a null language is a language of its own. Rows are judged one by one, so
    repeated rows stay or go together. Columns are as before, whatever their names; an empty table gives an empty table.
    """
    return quality_rules.keep_quality(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good, fitted on those of them that have labels.

    Without a labelled document every score is 0.5 and all stay. Null and empty texts get the score of an empty passage. Repeated
    rows stay or go together. Columns are as before, whatever their names; an empty table gives an empty table.
    """
    return mil_classifier.keep_predicted(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that another place keeps.

    Every row stays; a text that loses all lines is empty, a null text stays null. Rows that repeat a doc_id are told apart by
    their texts and lose their own lines alone. Columns are as before, whatever their names; an empty table gives an empty table.
    """
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Rows without an id come last; rows that repeat a doc_id are told apart by their texts. Null and empty texts are near
    duplicates of each other. Columns are as before, whatever their names; an empty table gives an empty table.
    """
    return simhash_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Parts of sequences with their token ids.

    Null and empty texts are an end token alone; repeated rows are packed each on their own; other columns are ignored; an
    empty table gives an empty table.
    """
    added = harmonic_packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return harmonic_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


STAGES = [
    ("quality_rules", quality),
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("packing", pack),
]

#: The classifier and the fingerprints are beyond SQL; tests/llm compares the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table that the next one reads.

    Once it is written, the tables that led to it are deleted; only the last stage's own stay, for the result reads them.
    """
    docs, before = table(spark, sf_dir, "documents"), made()
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        release(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
