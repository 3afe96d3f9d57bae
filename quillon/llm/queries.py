"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quillon.llm import chat, html_text, mixing, packing, quality_model, quality_rules, secret_scan, shingle_join, sql, suffix_dedup, topk

QUERIES = {
    "op1_quality_classifier": quality_model.op1_quality_classifier,
    "op2_html_text": html_text.op2_html_text,
    "op3_packing": packing.op3_packing,
    "op4_topk": topk.op4_topk,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_chat_format": chat.op6_chat_format,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_shingle_join": shingle_join.op8_shingle_join,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_mixing": mixing.op10_mixing,
}
ORACLE_SQL = {
    "op4_topk": sql.TOP_K,
    "op8_shingle_join": sql.NEAR_DUPLICATES,
    "op9_quality_rules": sql.QUALITY_RULES,
    "op10_mixing": mixing.OP10_SQL,
}
