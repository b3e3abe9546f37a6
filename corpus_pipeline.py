"""The corpus pipeline: five stages, each an operator applied to all that its predecessor kept.

1. language ID: documents whose language cannot be told go;
2. n-gram Jaccard join: of each group of near copies (five words, 0.8) the smallest id stays;
3. benchmark decontamination: documents that hold benchmark passages go;
4. secret scans: secrets are masked, documents stay;
5. byte-level BPE: what is left is encoded and decoded again.

All but the last return the columns of documents.

Defined cases: a null or empty text, or one without letters, has no language and goes in the first stage; repeated
rows are near copies, of which one stays; rows of one id count as one document, of which the second stage keeps
one row, and rows with a null id as documents of their own; a text is judged whole, however long; an empty table
gives no rows; further columns are handed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import byte_bpe, decontamination, jaccard_join, language_id, secrets
from fieldbook.llm.common import materialise, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE encoding and decoding", encode),
]

#: Classifiers and compiled merges cannot be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
