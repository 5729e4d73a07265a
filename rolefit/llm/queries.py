"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rolefit.llm.alignment import alignment
from rolefit.llm.conversations import damaged, repair
from rolefit.llm.decontaminate import contamination
from rolefit.llm.embedding_dedup import embedding_links
from rolefit.llm.html_text import main_text
from rolefit.llm.line_dedup import line_duplicates
from rolefit.llm.near_dedup import near_duplicates
from rolefit.llm.packing import pack
from rolefit.llm.pipeline import run
from rolefit.llm.quality import classify
from rolefit.llm.quality_rules import quality_rules
from rolefit.llm.substring_dedup import without_repeated_spans
from rolefit.llm.token_files import token_round_trip
from rolefit.llm.warc import warc_round_trip

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), size=4, percent=80)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_spans(_read(spark, sf_dir, "documents")).drop("kept")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_read(spark, sf_dir, "embeddings"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(_read(spark, sf_dir, "documents"), short_copies=True).drop("line_hash")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages"))


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_read(spark, sf_dir, "pages"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(_read(spark, sf_dir, "conversations")), live="live")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_minhash_near_dedup, op2_quality_classifier, op3_decontamination, op4_best_fit_packing, op5_repeated_substrings, op6_embedding_near_dedup, op7_token_files,
        op8_line_dedup, op9_html_main_text, op10_warc_archives, op11_quality_rules, op12_tokenizer_alignment, op13_conversation_repair, pipeline,
    )
    return {f.__name__: f for f in registered}
