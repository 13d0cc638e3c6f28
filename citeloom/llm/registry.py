"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from citeloom.llm import (
    exact_dedup,
    hamming_search,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    packing,
    passages,
    secrets,
    toxicity,
)

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_language_id": language_id.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_compact_windows": passages.op7_compact_windows,
    "op8_hamming_search": hamming_search.op8_hamming_search,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_ngram_jaccard_join": jaccard_join.OP6_SQL,
    "op8_hamming_search": hamming_search.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
