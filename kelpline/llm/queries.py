"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpline.llm import bpe, html, licenses, mixing, quality, rans, simhash, token_scan, urls, vectors
from kelpline.llm.tokens import public_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_token_counts(_documents(spark, sf_dir), public_path("byte_bpe_50k.json"), 50256)


def op4_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(_documents(spark, sf_dir), public_path("byte_bpe_50k.json"), 2).drop("last_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.by_document(_documents(spark, sf_dir))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_documents(spark, sf_dir), public_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).drop("score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_embeddings, op3_token_counts, op4_rans, op5_quality, op6_licenses, op7_html, op8_bpe, op9_urls, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_embeddings": vectors.SQL, "op5_quality": quality.SQL, "op10_mixing": mixing.SQL}
