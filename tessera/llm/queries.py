"""The queries this subpackage registers, and their DuckDB statements where SQL can say it."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, langid, license_scan, lm_score, near_dup, packing, toxicity, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_ngram_jaccard": near_dup.query,
    "op3_lm_score": lm_score.query,
    "op4_best_fit_packing": packing.query,
    "op5_language_id": langid.query,
    "op6_toxicity": toxicity.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_chat_format": chat.query,
    "op9_url_filter": url_filter.query,
    "op10_license_scan": license_scan.query,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op2_ngram_jaccard": near_dup.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_chat_format": chat.ORACLE_SQL,
}
