"""Queries of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_extraction, importance, line_dedup, mixing, multi_index, packing, quality_rules, secret_scan, simhash, toxicity

#: The others hash, tokenise, fit or search beyond SQL; tests/llm compares them with brute-force versions.
ORACLE: dict[str, str] = {"op8_quality_rules": quality_rules.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_multi_index": multi_index.op2_multi_index,
        "op3_packing": packing.op3_packing,
        "op4_html_extraction": html_extraction.op4_html_extraction,
        "op5_simhash": simhash.op5_simhash,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_mixing": mixing.op7_mixing,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_importance": importance.op9_importance,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }
