"""The registered queries of this subpackage and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

from reportloom.llm import best_fit_packing, chat_format, embedding_dedup, embedding_whitening, exact_dedup, license_scan, line_dedup, ngram_jaccard, periodic_runs, quality_rules, source_mix, token_counts, toxicity

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_embedding_dedup": embedding_dedup.query,
    "op3_quality_rules": quality_rules.query,
    "op4_source_mix": source_mix.query,
    "op5_license_scan": license_scan.query,
    "op6_toxicity": toxicity.query,
    "op7_best_fit_packing": best_fit_packing.query,
    "op8_ngram_jaccard": ngram_jaccard.query,
    "op9_line_dedup": line_dedup.query,
    "op10_token_counts": token_counts.query,
    "op11_embedding_whitening": embedding_whitening.query,
    "op12_exact_dedup": exact_dedup.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op4_source_mix": source_mix.SQL,
    "op5_license_scan": license_scan.SQL,
    "op12_exact_dedup": exact_dedup.SQL,
}
