"""Queries of this subpackage and, where SQL can express them, the SQL for the same rows."""

from __future__ import annotations

from moodtide.llm import decontamination, dominance, html_extraction, language, line_join, ngram_model, packing, quality_model, quality_rules, resampling, similarity, token_file, url_filter

QUERIES = {
    "op1_line_frequency": quality_rules.op1_line_frequency,
    "op2_mixture_language": language.op2_mixture_language,
    "op3_pattern_packing": packing.op3_pattern_packing,
    "op4_quadratic_quality": quality_model.op4_quadratic_quality,
    "op5_simple8b": token_file.op5_simple8b,
    "op6_jaccard_tiles": similarity.op6_jaccard_tiles,
    "op7_line_dedup": line_join.op7_line_dedup,
    "op8_redirect_classes": url_filter.op8_redirect_classes,
    "op9_tree_marginals": html_extraction.op9_tree_marginals,
    "op10_winnowing": decontamination.op10_winnowing,
    "op11_dominance": dominance.op11_dominance,
    "op12_elias_fano_trie": ngram_model.op12_elias_fano_trie,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
ORACLE_SQL = {
    "op1_line_frequency": quality_rules.ORACLE,
    "op6_jaccard_tiles": similarity.ORACLE,
    "op7_line_dedup": line_join.ORACLE,
    "op8_redirect_classes": url_filter.ORACLE,
    "op10_winnowing": decontamination.ORACLE,
    "op11_dominance": dominance.ORACLE,
    "op12_elias_fano_trie": ngram_model.ORACLE,
    "op13_importance_resampling": resampling.ORACLE,
}
