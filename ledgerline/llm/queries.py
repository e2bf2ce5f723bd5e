"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from ledgerline.llm import bpe, chat, class_lm, exact_dedup, packing, pii, quality, secrets, simhash, suffix, token_count, vector_codes, whitening

QUERIES = {
    "op1_suffix_array_dedup": suffix.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_secret_scan": secrets.query,
    "op4_bpe": bpe.query,
    "op5_chat_formatting": chat.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_class_lm": class_lm.query,
    "op8_packing": packing.query,
    "op9_pii_surrogates": pii.query,
    "op10_quality_rules": quality.query,
    "op11_vector_codes": vector_codes.query,
    "op12_whitening": whitening.query,
    "op13_token_counts": token_count.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_secret_scan": secrets.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
}
