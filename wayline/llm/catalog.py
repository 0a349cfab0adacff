"""Queries of the text operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import (
    bestfit, bpe, codes, exact, extract, lm, packing, pii, quality, simhash, spans, trie, warc,
)
from wayline.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), pii.TEST_KEY)


def op2_js_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.without_repeats(table(spark, sf_dir, "documents"))


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded_digests(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(table(spark, sf_dir, "embeddings"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.packed_digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    return {
        "op1_feistel_pii": op1_feistel_pii,
        "op2_js_quality": op2_js_quality,
        "op3_gray_simhash": op3_gray_simhash,
        "op4_text_density": op4_text_density,
        "op5_warc_segments": op5_warc_segments,
        "op6_concat_cut": op6_concat_cut,
        "op7_exact_groups": op7_exact_groups,
        "op8_sentence_spans": op8_sentence_spans,
        "op9_log_bilinear": op9_log_bilinear,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_vector_codes": op11_vector_codes,
        "op12_best_fit": op12_best_fit,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_js_quality": quality.ORACLE,
        "op5_warc_segments": warc.ORACLE,
        "op7_exact_groups": exact.ORACLE,
        "op11_vector_codes": codes.ORACLE,
        "op13_prefix_trie": trie.ORACLE,
    }
