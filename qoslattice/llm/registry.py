"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fill_middle, fingerprint, line_rules, mixing, pii, quality, secret_scan, simhash, spelling, token_counts, toxicity, url_filter
from .common import table

QUERIES = {
    "op1_secret_scan": lambda spark, d: secret_scan.secret_report(table(spark, d, "documents")),
    "op2_toxicity": lambda spark, d: toxicity.toxicity_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_quality": lambda spark, d: quality.quality_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_weighted_fingerprint": lambda spark, d: fingerprint.edited_report(table(spark, d, "documents")),
    "op5_pii": lambda spark, d: pii.pii_report(table(spark, d, "documents")),
    "op6_token_counts": lambda spark, d: token_counts.token_report(table(spark, d, "documents")),
    "op7_url_filter": lambda spark, d: url_filter.judge(table(spark, d, "pages")),
    "op8_decontaminate": lambda spark, d: decontaminate.contamination_report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_source_mix": lambda spark, d: mixing.mixing_report(table(spark, d, "documents")),
    "op10_simhash": lambda spark, d: simhash.near_dup_report(table(spark, d, "documents")),
    "op11_spelling_variants": lambda spark, d: spelling.variants_report(table(spark, d, "documents")),
    "op12_line_rules": lambda spark, d: line_rules.rules_report(table(spark, d, "documents")),
    "op13_fill_middle": lambda spark, d: fill_middle.fill_middle_report(table(spark, d, "documents")),
}

ORACLE_SQL = {
    "op1_secret_scan": secret_scan.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op11_spelling_variants": spelling.ORACLE_SQL,
    "op12_line_rules": line_rules.ORACLE_SQL,
    "op13_fill_middle": fill_middle.ORACLE_SQL,
}
