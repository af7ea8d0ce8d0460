"""The queries of this subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import bpe, cotraining, fingerprints, line_dedup, mixing, near_dedup, quality_rules, secrets, toxicity, url_model

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_cotrained_quality": cotraining.op1_cotrained_quality,
        "op2_winnowing_line_dedup": line_dedup.op2_winnowing_line_dedup,
        "op3_url_language_model": url_model.op3_url_language_model,
        "op4_grammar_secret_scan": secrets.op4_grammar_secret_scan,
        "op5_boosted_toxicity": toxicity.op5_boosted_toxicity,
        "op6_byte_level_bpe": bpe.op6_byte_level_bpe,
        "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
        "op8_risk_controlled_quality_rules": quality_rules.op8_risk_controlled_quality_rules,
        "op9_weighted_fair_mixing": mixing.op9_weighted_fair_mixing,
        "op10_paragraph_fingerprints": fingerprints.op10_paragraph_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_winnowing_line_dedup": line_dedup.SQL,
        "op8_risk_controlled_quality_rules": quality_rules.SQL,
        "op9_weighted_fair_mixing": mixing.SQL,
    }
