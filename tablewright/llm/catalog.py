"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, html_text, line_dedup, near_dup, packing, quality, sharding, token_files, toxicity, url_rules
from .common import table


def queries() -> dict:
    return {
        "op1_decontaminate": lambda spark, d: decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op2_toxicity": lambda spark, d: toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_html_text": lambda spark, d: html_text.digest(table(spark, d, "pages")),
        "op4_best_fit_packing": lambda spark, d: packing.pack_documents(table(spark, d, "documents")),
        "op5_fertility_rules": lambda spark, d: quality.digest(table(spark, d, "documents")),
        "op6_token_files": lambda spark, d: token_files.digest(table(spark, d, "documents")),
        "op7_line_dedup": lambda spark, d: line_dedup.digest(table(spark, d, "documents")),
        "op8_sharding": lambda spark, d: sharding.digest(table(spark, d, "documents")),
        "op9_bag_minhash": lambda spark, d: near_dup.digest(table(spark, d, "documents")),
        "op10_url_rules": lambda spark, d: url_rules.digest(table(spark, d, "pages")),
    }


def oracle_sql() -> dict:
    return {
        "op7_line_dedup": line_dedup.ORACLE_SQL,
        "op10_url_rules": url_rules.ORACLE_SQL,
    }
