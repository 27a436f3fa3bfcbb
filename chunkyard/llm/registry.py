"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, chat_format, decontaminate, language_id, line_dedup, lm_score, near_dedup, quality, shard, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_lm_score": lm_score.op1_lm_score,
        "op2_language_id": language_id.op2_language_id,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_bpe": bpe.op6_bpe,
        "op7_shard": shard.op7_shard,
        "op8_quality": quality.op8_quality,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": line_dedup.OP4_SQL,
        "op5_decontaminate": decontaminate.OP5_SQL,
        "op9_chat_format": chat_format.OP9_SQL,
    }
