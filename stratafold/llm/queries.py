"""Registered queries of the corpus operators: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratafold.llm.alignment import align_tokenizers
from stratafold.llm.chat_rotation import rotate_perspectives
from stratafold.llm.edit_decontam import benchmark_matches
from stratafold.llm.forced_boundaries import round_trip
from stratafold.llm.golomb_dedup import exact_dedup
from stratafold.llm.language_id import held_out, identify_languages
from stratafold.llm.license_scan import scan_licenses
from stratafold.llm.line_spread import strip_boilerplate
from stratafold.llm.mixing import mix_plan
from stratafold.llm.shared import read_documents
from stratafold.llm.simhash import simhash_components
from stratafold.llm.token_counts import count_tokens
from stratafold.llm.token_store import ids_crc32, token_table
from stratafold.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@_query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query()
def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir))


@_query()
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_documents(spark, sf_dir), distance=2, shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id")


@_query(r"""
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir))


@_query()
def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mix_plan(read_documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2.0)
    return planned.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


@_query()
def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_crc32(token_table(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


@_query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = identify_languages(docs, docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query()
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.end_char")


@_query(r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS position
  FROM documents
), bad AS (
  SELECT trim(line) AS bad_line FROM lines WHERE length(trim(line)) > 0
  GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(1))) >= 10
)
SELECT doc_id, count(*) FILTER (length(trim(line)) > 0) AS n_lines, count(bad_line) AS n_cut,
  md5(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (bad_line IS NULL), '')) AS text_md5
FROM lines LEFT JOIN bad ON trim(line) = bad_line GROUP BY doc_id
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = strip_boilerplate(read_documents(spark, sf_dir), site="source", min_sites=10)
    return cleaned.select("doc_id", "n_lines", "n_cut", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@_query(r"""
WITH turns AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // 256 AS part
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), rendered AS (
  SELECT turns.conv_id, part, speaker, turn, role, text,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
      ELSE 'user name=' || replace(role, '<|im_', '<| im_') END || chr(10) AS head,
    replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS body
  FROM turns JOIN speakers ON turns.conv_id IS NOT DISTINCT FROM speakers.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS done FROM rendered
)
SELECT conv_id, part, speaker, count(*) AS n_turns,
  CAST(sum(CASE WHEN role = speaker THEN length(body) ELSE 0 END) AS BIGINT) AS n_trained,
  md5(string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text)) AS text_md5,
  coalesce(string_agg(CAST(done - length(body) AS BIGINT) || '-' || CAST(done AS BIGINT), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (role = speaker), '') AS mask
FROM placed GROUP BY conv_id, part, speaker
""")
def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = rotate_perspectives(read_documents(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat(s["from"].cast("string"), F.lit("-"), s.to.cast("string"))), ",")
    return rotated.select("conv_id", "part", "speaker", "n_turns", "n_trained", F.md5(F.col("text").cast("binary")).alias("text_md5"), mask.alias("mask"))


@_query()
def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    done = round_trip(read_documents(spark, sf_dir).select("doc_id", "text"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query()
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    aligned = align_tokenizers(read_documents(spark, sf_dir), *paths, keep=["doc_id"], groups=digest)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@_query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whiten(read_documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=8)
    return whitened.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error")
