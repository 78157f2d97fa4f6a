"""Corpus operators for training-data pipelines, with their queries and DuckDB texts."""

from __future__ import annotations

from vacantia.llm import (
    best_fit,
    byte_bpe,
    chat_format,
    decontamination,
    exact_topk,
    near_dups,
    quality_rules,
    secret_scan,
    spelling,
    token_files,
    toxicity,
    url_filters,
    whitening,
)

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_near_dups": near_dups.op3_near_dups,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_best_fit": best_fit.op5_best_fit,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_exact_topk": exact_topk.op7_exact_topk,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_spelling": spelling.op12_spelling,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op4_quality_rules": quality_rules.oracle(),
    "op7_exact_topk": exact_topk.oracle(),
    "op9_url_filters": url_filters.oracle(),
    "op10_chat_format": chat_format.oracle(),
    "op11_decontamination": decontamination.oracle(),
    "op12_spelling": spelling.oracle(),
}
