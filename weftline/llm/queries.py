"""The corpus operators' queries: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import public_file, round_trip_report

    return round_trip_report(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import public_file
    from .packing import packed_report

    return packed_report(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"))


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_report

    return chat_report(table(spark, sf_dir, "conversations"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_components

    return near_components(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"), "key of the query alone, for made-up texts")


@query
def op13_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maintenance import maintenance_report

    return maintenance_report(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie_report

    return trie_report(table(spark, sf_dir, "conversations"))


@query
def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract_main

    return extract_main(table(spark, sf_dir, "pages"))
