"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import groups

    return groups(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import report

    return report(table(spark, sf_dir, "documents"), unit="byte")  # as the SQL's levenshtein counts


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import conversations_as_calls, link_tools

    return link_tools(*conversations_as_calls(table(spark, sf_dir, "conversations")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import report

    return report(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


#: A vocabulary file of a public tokenizer; None takes the one that is installed.
SENTENCEPIECE_MODEL: str | None = None


def sentencepiece_model():
    from .sentencepiece_codec import load_model

    path = SENTENCEPIECE_MODEL or os.environ.get("GLOSSA_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
    return load_model(path)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode

    return encode(table(spark, sf_dir, "documents"), sentencepiece_model())


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import report

    return report(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import report

    return report(table(spark, sf_dir, "documents"))


#: A byte-level vocabulary file of a public tokenizer; None takes the one that is installed.
BYTE_VOCABULARY: str | None = None


def alignment_files():
    from .token_alignment import Files

    bytes_path = BYTE_VOCABULARY or os.environ.get("GLOSSA_BYTE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
    return Files.read(bytes_path, SENTENCEPIECE_MODEL or os.environ.get("GLOSSA_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import report

    return report(table(spark, sf_dir, "documents"), alignment_files())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_dedup": op4_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_chat_format": op7_chat_format,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_html_extract": op9_html_extract,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_fingerprint": op11_fingerprint,
    "op12_fill_middle": op12_fill_middle,
    "op13_token_alignment": op13_token_alignment,
}
