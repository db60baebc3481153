"""A corpus pipeline: documents in, packed token sequences out.

Each stage works on all that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.best_fit_packing import pack_best_fit
from veilframe.llm.exact_dedup import drop_exact_duplicates
from veilframe.llm.jaccard_join import drop_near_duplicates
from veilframe.llm.language_id import keep_identified
from veilframe.llm.pii import mask_personal_data
from veilframe.llm.shared import kept, read_documents, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty texts, too), or far from every language's profile; none of no documents."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id; null texts count as empty ones."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more keep the one with the smallest doc_id; those without words all stay."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; null and empty ones stay as they are."""
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of at most 2048; a null or empty text is one token."""
    packed = pack_best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, size=2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL can't express the language profiles or the tokens; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents, each result stored before the next stage reads it.

    What a stage keeps for itself is deleted when its result is stored.
    """
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = kept(stage(spark, docs, sf_dir), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
