"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import fingerprints, html_text, langid, license_scan, media, merkle, near_dedup, packing, pii, secret_scan, spm, token_align, toxicity
from turnwise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_digests(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "matches", "licenses")])


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key, or a random one of this run where the session has none: nobody can undo these pseudonyms."""
    key = spark.conf.get(pii.KEY_CONF, None) or secrets.token_hex(32)
    return pii.pseudonymise_documents(table(spark, sf_dir, "documents"), key)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_corpus(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece_nbest": op1_sentencepiece_nbest,
        "op2_language_id": op2_language_id,
        "op3_secret_scans": op3_secret_scans,
        "op4_license_scans": op4_license_scans,
        "op5_media_columns": op5_media_columns,
        "op6_document_fingerprints": op6_document_fingerprints,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_pii": op8_pii,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_html_extraction": op10_html_extraction,
        "op11_toxicity": op11_toxicity,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    """The licence scan and the manifest are plain SQL; the others train models, or need hashes and vocabularies that DuckDB lacks."""
    return {"op4_license_scans": license_scan.duckdb_sql(), "op12_merkle_manifest": merkle.duckdb_sql()}
