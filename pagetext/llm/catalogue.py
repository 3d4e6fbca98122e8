"""Registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from pagetext.llm import op1_decontaminate, op2_revisits, op10_long_repeats, op11_resampling, op12_hard_negatives, op13_toxicity, op3_url_filter, op4_lattice_score, op5_jaccard_join, op6_quality, op7_mixing, op8_embedding_dedup, op9_token_counts

QUERIES = {
    "op1_decontaminate": op1_decontaminate.op1_decontaminate,
    "op2_revisits": op2_revisits.op2_revisits,
    "op10_long_repeats": op10_long_repeats.op10_long_repeats,
    "op11_resampling": op11_resampling.op11_resampling,
    "op12_hard_negatives": op12_hard_negatives.op12_hard_negatives,
    "op13_toxicity": op13_toxicity.op13_toxicity,
    "op3_url_filter": op3_url_filter.op3_url_filter,
    "op4_lattice_score": op4_lattice_score.op4_lattice_score,
    "op5_jaccard_join": op5_jaccard_join.op5_jaccard_join,
    "op6_quality": op6_quality.op6_quality,
    "op7_mixing": op7_mixing.op7_mixing,
    "op8_embedding_dedup": op8_embedding_dedup.op8_embedding_dedup,
    "op9_token_counts": op9_token_counts.op9_token_counts,
}
ORACLES = {
    "op12_hard_negatives": op12_hard_negatives.ORACLE,
    "op2_revisits": op2_revisits.ORACLE,
    "op3_url_filter": op3_url_filter.ORACLE,
}
