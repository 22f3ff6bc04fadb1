"""The training-data queries and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, cotraining, decontaminate, katz, line_dedup, minhash, quality_rules, suffix_dedup, url_filters

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_minhash": minhash.op3_minhash,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_chat_format": chat_format.op5_chat_format,
    "op7_url_filters": url_filters.op7_url_filters,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op8_katz": katz.op8_katz,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_cotraining": cotraining.op10_cotraining,
}

ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": line_dedup.ORACLE,
}
