"""The operators' queries and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from orbweave.llm import bpe, decontaminate, minhash, pieces, quality, resampling, shards, suffixes, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_importance_resampling": resampling.op2_importance_resampling,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_counts": bpe.op4_token_counts,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_token_files": bpe.op6_token_files,
    "op7_histogram_shards": shards.op7_histogram_shards,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_adaptive_rules": quality.op9_adaptive_rules,
    "op10_minhash": minhash.op10_minhash,
}
ORACLES = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op8_suffix_dedup": suffixes.OP8_SQL,
    "op9_adaptive_rules": quality.OP9_SQL,
    "op10_minhash": minhash.OP10_SQL,
}
