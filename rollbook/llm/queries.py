"""Registered queries of the subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import (
    alignment,
    ann,
    bpe_reuse,
    chat,
    decontam,
    divergence,
    html_crf,
    license_scan,
    near_dup,
    packing,
    piece_counts,
    quality_qda,
    sharding,
)
from rollbook.llm.common import stored_once
from rollbook.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def byte_bpe() -> bytes:
    """The public byte-level vocabulary; the driver reads it, executors get it as a broadcast."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        return file.read()


def piece_bpe() -> bytes:
    """The public piece vocabulary, as a model file's content."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query
def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_crf.extract(read_table(spark, sf_dir, "pages"))


@query
def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of two-word shingle sets, and whether it stays."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), width=2)


#: A user and an assistant turn that hold the template's own control strings.
TRICKY = r"\### Assistant: </turn> ok"


@query
def op4_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation's turns and masked texts, read back from its formatted ids."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    return chat.read_back(chat.format_conversations(rows.unionByName(tricky), byte_bpe()), byte_bpe())


@query
def op5_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return bpe_reuse.encode_documents(docs, byte_bpe(), ("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op7_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from labels of the rows that are not held out."""
    statistics = stored_once(spark, quality_qda.with_statistics(read_table(spark, sf_dir, "documents")), "statistics")
    model = quality_qda.train(statistics, read_table(spark, sf_dir, "labels"))
    return quality_qda.score(statistics, model)


@query
def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that a window of it comes near."""
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


ORACLES["op2_license_scan"] = license_scan.scan_sql()


@query
def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in packed rows."""
    return packing.pack(read_table(spark, sf_dir, "documents"), byte_bpe())


@query
def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match pieces of every document."""
    return piece_counts.count_pieces(read_table(spark, sf_dir, "documents"), byte_bpe())


@query
def op6_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every vector whose id is divisible by 50."""
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op11_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, eight shards of near equal bytes."""
    return sharding.shard_records(read_table(spark, sf_dir, "documents"))


ORACLES["op11_sampled_splitters"] = sharding.shards_sql()


@query
def op12_run_length_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from every other one, and the terms it has more of than the language."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


ORACLES["op12_run_length_divergence"] = divergence.audit_sql()


@query
def op13_arrow_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens by the byte-level and the piece vocabulary."""
    return alignment.align(read_table(spark, sf_dir, "documents"), byte_bpe(), piece_bpe())
