"""Corpus pipeline: quality, near-duplicates, contamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; run() writes each result as Parquet and reads it back as the
next one's docs. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollbook.llm import bpe_reuse, decontam, near_dup, quality_qda
from rollbook.llm.common import stored_once
from rollbook.llm.queries import byte_bpe
from rollbook.session import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant takes for good ones."""
    statistics = stored_once(spark, quality_qda.with_statistics(docs), "statistics")
    return quality_qda.keep_good(docs, quality_qda.train(statistics, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles."""
    return near_dup.keep_one(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is near an item of the benchmark."""
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and the digest of the text they decode to."""
    return bpe_reuse.encode_documents(docs, byte_bpe(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: No stage but the last could be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from the table the one before has written."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored_once(spark, docs, f"stage{k}")
    return docs
