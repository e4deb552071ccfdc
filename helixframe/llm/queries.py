"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, jaccard, langid, lattice, lz_dedup, packing, suffix_dedup, tokenfile, webp
from .tokens import public_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": lambda s, d: langid.op1_language_id(documents(s, d)),
    "op2_packing": lambda s, d: packing.op2_packing(documents(s, d), public_path("word_bpe_49k.json")),
    "op3_suffix_dedup": lambda s, d: suffix_dedup.op3_suffix_dedup(documents(s, d)),
    "op4_decontamination": lambda s, d: decontamination.op4_decontamination(documents(s, d), table(s, d, "benchmark")),
    "op5_token_file": lambda s, d: tokenfile.op5_token_file(documents(s, d), public_path("byte_bpe_50k.json")),
    "op6_chat_format": lambda s, d: chat.op6_chat_format(table(s, d, "conversations")),
    "op7_jaccard_join": lambda s, d: jaccard.op7_jaccard_join(documents(s, d)),
    "op8_lattice_score": lambda s, d: lattice.op8_lattice_score(documents(s, d), public_path("piece_bpe_32k.model")),
    "op9_lossless_webp": lambda s, d: webp.op9_lossless_webp(documents(s, d)),
    "op10_passage_dedup": lambda s, d: lz_dedup.op10_passage_dedup(documents(s, d)),
}

ORACLE_SQL: dict[str, str] = {}
