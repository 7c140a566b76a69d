"""Registered queries of this package: the operators over their whole tables, and the pipeline."""
from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, context_mix, histogram_sort, host_quality, license_scan, line_chunks, mixing, pair_bounds, radix_dedup, simhash, suffix_dedup, token_align, warc
from plumbline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_warc_segments(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf, "pages"))


def op2_context_mix(spark: SparkSession, sf: str) -> DataFrame:
    return context_mix.scored(table(spark, sf, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf, "documents")).drop("kept")


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf, "documents"))


def op5_host_quality(spark: SparkSession, sf: str) -> DataFrame:
    return host_quality.quality_query(table(spark, sf, "documents"))


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op7_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return line_chunks.dedup_query(table(spark, sf, "documents"))


def op8_radix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return radix_dedup.exact_dedup(table(spark, sf, "documents"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_query(table(spark, sf, "documents"))


def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.tokenized(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)


def op11_pair_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return pair_bounds.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_token_align(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_align.aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_histogram_sort(spark: SparkSession, sf: str) -> DataFrame:
    return histogram_sort.sharded(table(spark, sf, "documents").select("doc_id", "text"), with_text=False)


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_warc_segments": (op1_warc_segments, warc.ORACLE),
    "op2_context_mix": (op2_context_mix, None),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op4_license_scan": (op4_license_scan, license_scan.ORACLE),
    "op5_host_quality": (op5_host_quality, host_quality.ORACLE),
    "op6_simhash": (op6_simhash, None),
    "op7_line_chunks": (op7_line_chunks, None),
    "op8_radix_dedup": (op8_radix_dedup, radix_dedup.ORACLE),
    "op9_mixing": (op9_mixing, None),
    "op10_byte_bpe": (op10_byte_bpe, None),
    "op11_pair_bounds": (op11_pair_bounds, pair_bounds.ORACLE),
    "op12_token_align": (op12_token_align, None),
    "op13_histogram_sort": (op13_histogram_sort, histogram_sort.ORACLE),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
