"""The queries of this subpackage, by name."""

from __future__ import annotations

from . import decontaminate, divergence, fingerprints, hard_negatives, licenses, linededup, packing, passages, quality, simhash, token_counts, token_files, vector_packing


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_license_scan": licenses.op3,
        "op4_substring_dedup": passages.op4,
        "op5_document_fingerprints": fingerprints.op5,
        "op6_token_counts": token_counts.op6,
        "op7_quality_classifier": quality.op7,
        "op8_line_dedup": linededup.op8,
        "op9_token_files": token_files.op9,
        "op10_simhash_near_dedup": simhash.op10,
        "op11_hard_negatives": hard_negatives.op11,
        "op12_vector_packing": vector_packing.op12,
        "op13_source_divergence": divergence.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": licenses.OP3_SQL,
        "op8_line_dedup": linededup.OP8_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op13_source_divergence": divergence.OP13_SQL,
    }
