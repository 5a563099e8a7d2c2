"""The subpackage's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, html_extract, license_scan, ngram, pii, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_simhash": simhash.query,
    "op4_html_extract": html_extract.query,
    "op5_license_scan": license_scan.query,
    "op6_lm_score": ngram.query,
    "op7_pii": pii.query,
    "op8_decontaminate": decontaminate.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_bpe": bpe.query,
}

ORACLES = {"op2_exact_dedup": exact_dedup.SQL}
