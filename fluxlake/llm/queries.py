"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, embedding_dedup, html_extraction, language_id, ngram_join, packing, quality_gam, quality_rules, secret_scan, topk_search, vector_codes


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_bpe": bpe.op2_bpe,
        "op3_language_id": language_id.op3_language_id,
        "op4_html_extraction": html_extraction.op4_html_extraction,
        "op5_quality_gam": quality_gam.op5_quality_gam,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_packing": packing.op7_packing,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_topk_search": topk_search.op11_topk_search,
        "op12_vector_codes": vector_codes.op12_vector_codes,
    }


def oracle_sql() -> dict:
    return {"op1_quality_rules": quality_rules.ORACLE, "op6_chat_format": chat_format.ORACLE, "op11_topk_search": topk_search.ORACLE, "op12_vector_codes": vector_codes.ORACLE}
