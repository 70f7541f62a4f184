"""Queries of the llm subpackage and their oracle SQL."""

from __future__ import annotations

from . import boilerplate, language, leakage, pairs, pii, scans, tokenize

QUERIES = {
    "p1_found": pairs.p1_found,
    "p1_defect_counts": pairs.p1_defect_counts,
    "p2_found": boilerplate.p2_found,
    "p2_cleaned": boilerplate.p2_cleaned,
    "p3_found": scans.p3_found,
    "p3_paragraphs": scans.p3_paragraphs,
    "p4_found": pii.p4_found,
    "p4_redacted": pii.p4_redacted,
    "p6_ids": tokenize.p6_ids,
    "p6_token_counts": tokenize.p6_token_counts,
    "p7_found": leakage.p7_found,
    "p7_leaks_per_item": leakage.p7_leaks_per_item,
    "p8_found": language.p8_found,
    "p8_languages": language.p8_languages,
}
ORACLE_SQL: dict[str, str] = {}
