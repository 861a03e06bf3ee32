"""Queries of this subpackage by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, embedding_dedup, exact_dedup, html_extract, importance, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, word_runs

QUERIES = {
    "op1_context_mixing": mixing.op1_context_mixing,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_sharding": sharding.op6_sharding,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_word_runs": word_runs.op12_word_runs,
    "op13_embedding_near_dedup": embedding_dedup.op13_embedding_near_dedup,
}

ORACLE = {
    "op3_line_dedup": line_dedup.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op10_minhash_near_dedup": near_dedup.SQL,
    "op11_importance_resampling": importance.SQL,
    "op12_word_runs": word_runs.SQL,
    "op13_embedding_near_dedup": embedding_dedup.SQL,
}
