"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .benchmark_leaks import contamination
from .chroma_fingerprint import aligned_recordings, as_recordings
from .common import table
from .filter_audit import filter_audit
from .license_scan import as_source_tree, license_scan
from .line_dedup import line_digest
from .minhash_dedup import near_duplicates
from .mixture import mixture
from .quotation_links import as_mail_threads, conversation_digest
from .quality_qda import score_documents
from .sentencepiece_codec import codec_digest, public_model_path
from .substring_dedup import passage_digest
from .vector_codes import code_digest
from .vector_search import nearest_neighbours


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(as_source_tree(table(spark, sf_dir, "documents")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digest(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digest(table(spark, sf_dir, "documents"), public_model_path())


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_recordings(as_recordings(table(spark, sf_dir, "documents")))


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digest(as_mail_threads(table(spark, sf_dir, "conversations")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digest(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash": op3_minhash,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixture": op6_mixture,
    "op7_vector_search": op7_vector_search,
    "op8_chroma": op8_chroma,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quotation_links": op10_quotation_links,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_benchmark_leaks": op13_benchmark_leaks,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.PASSAGES,
    "op3_minhash": oracles.NEAR_COPIES,
    "op5_line_dedup": oracles.LINES,
    "op10_quotation_links": oracles.QUOTES,
    "op11_vector_codes": oracles.CODES,
    "op12_filter_audit": oracles.AUDIT,
    "op13_benchmark_leaks": oracles.LEAKS,
}
