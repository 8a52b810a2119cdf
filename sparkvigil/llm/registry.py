"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, contamination, html_text, jaccard, langid, mixing, neighbours, passages, sharding, suffixes

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_chat_format": chat.op2_chat_format,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_extract_text": html_text.op4_extract_text,
    "op5_find_benchmark": contamination.op5_find_benchmark,
    "op6_dedup_passages": passages.op6_dedup_passages,
    "op7_shard_documents": sharding.op7_shard_documents,
    "op8_jaccard_components": jaccard.op8_jaccard_components,
    "op9_dedup_bytes": suffixes.op9_dedup_bytes,
    "op10_nearest": neighbours.op10_nearest,
}
SQL = {"op2_chat_format": chat.SQL, "op3_mix_sources": mixing.SQL, "op5_find_benchmark": contamination.SQL, "op6_dedup_passages": passages.SQL, "op8_jaccard_components": jaccard.SQL}
