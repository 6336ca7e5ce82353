"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from . import decontamination, fingerprints, jaccard, language, licenses, linededup, packing, pii, scoring, toxicity
from .common import table


def queries() -> dict:
    return {
        "op1_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op2_license_scan": lambda spark, d: licenses.scan_licenses(table(spark, d, "documents")),
        "op3_line_dedup": lambda spark, d: linededup.query(table(spark, d, "documents")),
        "op4_best_fit_packing": lambda spark, d: packing.query(table(spark, d, "documents")),
        "op5_lm_scoring": lambda spark, d: scoring.query(table(spark, d, "documents")),
        "op6_language_id": lambda spark, d: language.query(table(spark, d, "documents")),
        "op7_document_fingerprints": lambda spark, d: fingerprints.fingerprints(table(spark, d, "documents")),
        "op8_ngram_jaccard_join": lambda spark, d: jaccard.join(table(spark, d, "documents")),
        "op9_decontamination": lambda spark, d: decontamination.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op10_personal_data": lambda spark, d: pii.find_personal_data(table(spark, d, "documents")),
    }


def oracle_sql() -> dict:
    return {"op2_license_scan": licenses.oracle_sql()}
