"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tideql.llm import chat, decontaminate, lm, mixing, pii, quality, rules, simhash, tokens, toxicity

QUERIES = {
    "op1_lm_scoring": lm.query,
    "op2_mixing_sources": mixing.query,
    "op3_pii": pii.query,
    "op6_chat_formatting": chat.query,
    "op7_token_counts": tokens.query,
    "op5_quality_rules": rules.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op8_quality_classifier": quality.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_toxicity": toxicity.query,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op2_mixing_sources": mixing.SQL,
    "op4_benchmark_decontamination": decontaminate.SQL,
    "op5_quality_rules": rules.SQL,
    "op6_chat_formatting": chat.SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
