"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, lm_scoring, media, mixing, near_dedup, pattern_packing, quality, substring_dedup, token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            quality.op1_quality_rules,
            lm_scoring.op2_lm_scoring,
            licenses.op3_license_scan,
            token_output.op4_token_output,
            substring_dedup.op5_suffix_array_dedup,
            substring_dedup.op6_substring_dedup,
            media.op7_media_columns,
            mixing.op8_source_mixing,
            pattern_packing.op9_best_fit_packing,
            near_dedup.op10_simhash,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE, "op8_source_mixing": mixing.ORACLE}
