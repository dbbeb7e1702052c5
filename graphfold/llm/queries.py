"""Registry of this subpackage's queries and SQL, read by __spark_entry__."""

from graphfold.llm import best_fit_packing, chat_format, decontamination, jaccard_join, language_id, lm_scoring, quality_rules, secret_scan, substring_dedup, suffix_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_best_fit_packing": best_fit_packing.query,
    "op3_language_id": language_id.query,
    "op4_ngram_jaccard_join": jaccard_join.query,
    "op5_quality_rules": quality_rules.query,
    "op6_chat_formatting": chat_format.query,
    "op7_suffix_array_dedup": suffix_dedup.query,
    "op8_secret_scans": secret_scan.query,
    "op9_benchmark_decontamination": decontamination.query,
    "op10_lm_scoring": lm_scoring.query,
}

ORACLES = {"op4_ngram_jaccard_join": jaccard_join.ORACLE_SQL, "op6_chat_formatting": chat_format.ORACLE_SQL}
