"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import byte_bpe, fingerprints, langid, mixing, neardup, quality_cnn, quality_rules, secret_scan, token_count, toxicity

QUERIES = {
    "op1_quality_cnn": quality_cnn.op1,
    "op2_fingerprints": fingerprints.op2,
    "op3_toxicity": toxicity.op3,
    "op4_token_counts": token_count.op4,
    "op5_language": langid.op5,
    "op6_near_duplicates": neardup.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_secret_scans": secret_scan.op8,
    "op9_mixing": mixing.op9,
    "op10_byte_bpe": byte_bpe.op10,
}
ORACLES = {"op6_near_duplicates": neardup.ORACLE, "op8_secret_scans": secret_scan.ORACLE, "op9_mixing": mixing.ORACLE}
