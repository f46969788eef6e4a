"""Queries opN_<name> of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, jaccard_join, langid, lm, lot_matching, mixing, packing, quality, substring_dedup, toxicity, urls, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": jaccard_join.op1,
        "op2_source_mixing": mixing.op2,
        "op3_lm_scoring": lm.op3,
        "op4_toxicity": toxicity.op4,
        "op5_substring_dedup": substring_dedup.op5,
        "op6_url_filter": urls.op6,
        "op7_language_id": langid.op7,
        "op8_decontaminate": decontaminate.op8,
        "op9_quality_rules": quality.op9,
        "op10_html_extraction": html_text.op10,
        "op11_packing": packing.op11,
        "op12_lot_matching": lot_matching.op12,
        "op13_vector_codes": vector_codes.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixing.ORACLE, "op12_lot_matching": lot_matching.ORACLE, "op13_vector_codes": vector_codes.oracle()}
