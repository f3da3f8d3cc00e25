"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from millrace.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    language_id,
    lm_score,
    ngram_jaccard,
    quality,
    token_files,
    toxicity,
)

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_lm_score": lm_score.query,
    "op3_toxicity": toxicity.query,
    "op4_decontaminate": decontaminate.query,
    "op5_ngram_jaccard": ngram_jaccard.query,
    "op6_chat_format": chat_format.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_token_files": token_files.query,
    "op10_quality": quality.query,
}
SQL = {
    "op4_decontaminate": decontaminate.SQL,
    "op5_ngram_jaccard": ngram_jaccard.SQL,
    "op6_chat_format": chat_format.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
}
