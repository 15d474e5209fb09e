"""Registered queries of the subpackage and their SQL restatements."""

from __future__ import annotations

from cohortspark.llm import (
    decontaminate, filter_audit, html_text, language, near_dedup, packing, quality, substring_dedup, token_files, toxicity, url_filter, vector_codes,
    vector_dedup,
)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_packing": packing.op3_packing,
    "op4_html_text": html_text.op4_html_text,
    "op5_vector_dedup": vector_dedup.op5_vector_dedup,
    "op6_language_id": language.op6_language_id,
    "op7_token_files": token_files.op7_token_files,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_quality": quality.op11_quality,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
