"""The corpus operators' registered queries and their DuckDB oracles."""

from __future__ import annotations

from koine.llm import bpe, exact_dedup, html_text, jaccard_join, license_scan, mixing, neighbours, quality, substring_dedup, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_neighbours": neighbours.query,
    "op3_quality": quality.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_mixing": mixing.query,
    "op6_html_text": html_text.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_license_scan": license_scan.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_bpe": bpe.query,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
}
