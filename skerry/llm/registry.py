"""Queries and SQL of the corpus operators and their pipeline."""

from __future__ import annotations

from . import (
    alignment,
    chat_format,
    decontaminate,
    filter_audit,
    language_id,
    packing,
    pii,
    quality_rules,
    simhash,
    sql,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
)

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc": warc.op6_warc,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLES = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_chat_format": sql.OP4,
    "op6_warc": sql.OP6,
    "op10_quality_rules": sql.OP10,
    "op11_filter_audit": filter_audit.OP11_SQL,
}
