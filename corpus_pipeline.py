"""From documents to training tokens in five stages; the next one reads what the one before has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratafold.llm.edit_decontam import decontaminate
from stratafold.llm.language_id import held_out, keep_fluent
from stratafold.llm.mixing import mix
from stratafold.llm.near_copies import drop_near_copies
from stratafold.llm.shared import read_documents, staged
from stratafold.llm.token_store import ids_crc32, token_table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the training rows: texts without a letter go, and those whose n-grams are far less probable than theirs."""
    return keep_fluent(docs, ~held_out())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the document with the smallest doc_id."""
    return drop_near_copies(docs, similarity=0.8, shingle=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, read_documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: none, once or twice."""
    return mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the binary format; doc_id, start, n_tokens and checksum of every document as read back."""
    return ids_crc32(token_table(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_ids),
]

ORACLE_SQL = None  # learned languages, XXH64 fingerprints and hashed draws are beyond SQL; tests have a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a Parquet table in the shared folder."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
