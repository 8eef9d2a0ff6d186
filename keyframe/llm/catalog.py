"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_ngram_jaccard", "op2_suffix_dedup", "op3_toxicity", "op4_quality", "op5_language_id", "op6_mixing", "op7_html_extract", "op8_packing", "op9_winnowing", "op10_permutation_ann"]


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{name}"), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = ((name, getattr(import_module(f"{__package__}.{name}"), "ORACLE_SQL", None)) for name in MODULES)
    return {name: sql for name, sql in found if sql}
