"""Queries of this package and their oracle SQL."""

from __future__ import annotations

from equiflow.llm import (
    decontamination, exact_dedup, importance_resampling, jaccard_join, language_id, line_dedup, lm_scoring, near_vectors, packing, secret_scan, token_counts, warc, whitening)


def queries():
    return {
        "op1_packing": packing.op1_packing,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_lm_scoring": lm_scoring.op3_lm_scoring,
        "op4_language_id": language_id.op4_language_id,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_warc": warc.op8_warc,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_whitening": whitening.op11_whitening,
        "op12_importance_resampling": importance_resampling.op12_importance_resampling,
        "op13_near_vectors": near_vectors.op13_near_vectors,
    }


def oracle_sql():
    return {"op2_exact_dedup": exact_dedup.OP2_SQL, "op8_warc": warc.OP8_SQL}
