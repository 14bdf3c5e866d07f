"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from . import decontaminate, exact, jaccard, licenses, mixing, passages, quality, suffixes, tokens, toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_token_files": tokens.op2_token_files,
        "op3_suffix_dedup": suffixes.op3_suffix_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality": quality.op5_quality,
        "op6_exact_dedup": exact.op6_exact_dedup,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_license_scan": licenses.op8_license_scan,
        "license_variants": licenses.license_variants,
        "op9_passages": passages.op9_passages,
        "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    }


def oracles() -> dict:
    return {
        "op1_mix_sources": mixing.SQL,
        "op6_exact_dedup": exact.SQL,
        "op7_decontaminate": decontaminate.SQL,
        "op8_license_scan": licenses.SQL,
        "license_variants": licenses.VARIANTS_SQL,
    }
