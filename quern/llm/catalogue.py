"""Queries and SQL of this subpackage."""

from __future__ import annotations

from quern.llm import byte_bpe, fingerprint, hard_negatives, html_extract, line_dedup, merkle, ngram_join, packing, quality_model, quality_rules, secret_scan, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_html_extraction": html_extract.op2_html_extraction,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_fingerprint": fingerprint.op4_fingerprint,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality_model": quality_model.op6_quality_model,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_secret_scan": secret_scan.op12_secret_scan,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict:
    return {"op3_ngram_join": ngram_join.OP3_SQL, "op8_url_filter": url_filter.OP8_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op10_quality_rules": quality_rules.OP10_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op12_secret_scan": secret_scan.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
