"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe_encoding, byte_dedup, decontamination, html_text, importance, jaccard_join, lm_scoring, packing, quality_rules, sharding, spelling, substring_dedup, warc_index

MODULES = {
    "op1_warc_index": warc_index,
    "op2_decontamination": decontamination,
    "op3_quality_rules": quality_rules,
    "op4_html_text": html_text,
    "op6_jaccard_join": jaccard_join,
    "op7_lm_scoring": lm_scoring,
    "op8_byte_dedup": byte_dedup,
    "op9_sharding": sharding,
    "op10_packing": packing,
    "op5_substring_dedup": substring_dedup,
    "op11_bpe_encoding": bpe_encoding,
    "op12_spelling_variants": spelling,
    "op13_importance_resampling": importance,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in MODULES.items() if getattr(module, "ORACLE", None)}
