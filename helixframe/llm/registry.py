"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import byte_bpe, exact_dedup, first_fit, html_text, importance, language_id, licence_scan, packing, personal_data, quality_rules, simhash, spelling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_html_text": html_text.op4_html_text,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_licence_scan": licence_scan.op7_licence_scan,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_first_fit_packing": first_fit.op11_first_fit_packing,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op7_licence_scan": licence_scan.ORACLE,
}
