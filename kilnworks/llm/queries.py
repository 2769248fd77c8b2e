"""The queries of this subpackage, as __spark_entry__.py registers them: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.llm import fingerprints, media, mixing, near_dups, oracle, packing, secrets, substrings, token_counts, token_files, toxicity, workspace
from kilnworks.llm.workspace import documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
BYTES_IDS = 50257


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), PIECES)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.place(spark, "tokens")  # as an intermediate table; files at a path of the caller's own stay
    token_files.write_tokens(documents(spark, sf_dir).select("doc_id", "text"), BYTES, end=2, vocabulary=BYTES_IDS, path=path)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir).select("doc_id", "text"), BYTES, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_stored(media.store_texts(documents(spark, sf_dir).select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_fingerprints, op3_mixing, op4_token_files, op5_near_dups, op6_substrings, op7_packing, op8_toxicity, op9_secrets, op10_media)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
