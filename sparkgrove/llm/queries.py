"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkgrove.llm import chat, decontamination, langid, line_dedup, ngram_join, packing, pii, tiff, tokens, toxicity
from sparkgrove.llm.common import table

WORD_BPE = "word_bpe_49k.json"


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media_digest(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), words=5, percent=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


PLANTED_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digest(turns.unionByName(spark.createDataFrame(PLANTED_CONVERSATION, "conv_id long, turn long, role string, text string")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end=2)
    return tokens.read_token_files(files)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), threshold=2)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end=1, capacity=2048)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tiff": op1_tiff,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_chat": op4_chat,
    "op5_token_files": op5_token_files,
    "op6_pii": op6_pii,
    "op7_line_dedup": op7_line_dedup,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op4_chat": chat.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
}
