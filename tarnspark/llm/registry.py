"""The queries of this subpackage, by the names under which the entry module registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnspark.llm import chat, media_chunks, mixing, quality_net, quality_rules, sentence_pieces, simhash, suffix_dedup, token_records, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_chunks": media_chunks.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_token_records": token_records.query,
    "op4_chat_formatting": chat.query,
    "op5_mixing": mixing.query,
    "op6_toxicity": toxicity.query,
    "op7_quality_rules": quality_rules.query,
    "op8_sentence_pieces": sentence_pieces.query,
    "op9_quality_net": quality_net.query,
    "op10_suffix_array_dedup": suffix_dedup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_media_chunks": media_chunks.ORACLE,
    "op2_simhash_near_dedup": simhash.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op10_suffix_array_dedup": suffix_dedup.ORACLE,
}
