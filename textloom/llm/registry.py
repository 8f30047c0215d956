"""Queries of the training-data operators and, where SQL can express them, the SQL."""

from __future__ import annotations

from textloom.llm import bpe, decontamination, exact_dedup, katz, mixing, ngram_join, runs, secrets, sharding, spelling, suffix_dedup, surrogates, toxicity

QUERIES = {
    "op1_surrogates": surrogates.op1_surrogates,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_sharding": sharding.op3_sharding,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_secrets": secrets.op8_secrets,
    "op9_bpe": bpe.op9_bpe,
    "op10_katz": katz.op10_katz,
    "op11_runs": runs.op11_runs,
    "op12_mixing": mixing.op12_mixing,
    "op13_spelling": spelling.op13_spelling,
}
ORACLES = {"op4_exact_dedup": exact_dedup.SQL}
