"""Registry of the training-data operators: each over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import (chat_format, decontaminate, jaccard_join, language_id, lm_score, merkle, mixing, nearest, quality_rules,
                           sharding, substring_dedup, token_alignment, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_lm_score": lm_score.op4_lm_score,
    "op4_lm_score_trigram": lm_score.op4_lm_score_trigram,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_language_id": language_id.op6_language_id,
    "op7_mixing": mixing.op7_mixing,
    "op8_sharding": sharding.op8_sharding,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_nearest": nearest.op10_nearest,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": chat_format.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_sharding": sharding.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_quality_rules": quality_rules.ORACLE,
}
