"""A pipeline over documents: each stage is one operator of kelpline.llm, written and read again before the next.

run() keeps what quality rules, near-duplicate search and mixing leave, and tokenises it. Its rows have no SQL: fingerprints and
byte-pair merges aren't expressible there; tests hold it against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpline.llm import bpe, mixing, quality, simhash
from kelpline.llm.shared import stage
from kelpline.llm.tokens import public_path

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: not those under 50 words, so no null or empty ones, nor those beyond the fences of their
    language and source. Null languages and sources are groups of their own; repeated rows are judged each and stay or go alike; texts of
    any length are judged whole; all columns stay as they are; an empty table stays empty."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose sets of five-word shingles are similar, 0.8 or more, the document with the smallest doc_id. Documents
    without words are alike; rows without doc_id stay; of rows that repeat a doc_id with similar texts one stays, which one is arbitrary
    where their other columns differ; all columns stay as they are; an empty table stays empty."""
    return simhash.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to twice, by the targets of their sources; null is a source. Documents without words
    are mixed like others; rows that repeat a doc_id are documents each; all columns stay as they are; an empty table stays empty."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document in the mix: doc_id, n_tokens and the digests of its ids and of what they decode to. Null texts are empty and have no
    ids; repeated rows give repeated rows; null doc_ids stay null; texts of any length are encoded whole; an empty table stays empty."""
    import public_tokenizers

    return bpe.digests(docs, public_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("mix", mix_sources), ("tokenise", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, of in STAGES:
        docs = stage(of(spark, docs, sf_dir), name)
    return docs
