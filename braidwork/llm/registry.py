"""Queries of the text operators and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline

from . import chat, passages, pieces, quality, secrets, simhash, suffixes, tiling, toxicity, vectors

QUERIES = {
    "op1_secrets": secrets.query,
    "op2_chat": chat.query,
    "op3_sentencepiece": pieces.query,
    "op4_passages": passages.query,
    "op5_suffix_dedup": suffixes.query,
    "op6_simhash": simhash.query,
    "op7_toxicity": toxicity.query,
    "op8_tiling": tiling.query,
    "op9_quality": quality.query,
    "op10_embeddings": vectors.query,
    "pipeline": corpus_pipeline.run,
    "chat_turns": chat.turns_query,
}
ORACLE_SQL = {
    "op1_secrets": secrets.ORACLE_SQL,
    "op5_suffix_dedup": suffixes.ORACLE_SQL,
    "op10_embeddings": vectors.ORACLE_SQL,
    "chat_turns": chat.TURNS_SQL,
}
