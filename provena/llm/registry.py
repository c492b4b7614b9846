"""Queries of the training-data operators. SQL holds those that DuckDB can express."""

from __future__ import annotations

from . import op1_quality, op2_langid, op3_mixing, op4_pii, op5_lines, op6_toxicity, op7_secrets, op8_packing, op9_metric_join, op10_minhash, op11_pitman_yor, op12_phrases, op13_audit

QUERIES = {
    "op1_quality_classifier": op1_quality.query,
    "op2_language_id": op2_langid.query,
    "op3_source_mixing": op3_mixing.query,
    "op4_pii": op4_pii.query,
    "op5_quality_rules": op5_lines.query,
    "op6_toxicity": op6_toxicity.query,
    "op7_secret_scan": op7_secrets.query,
    "op8_packing": op8_packing.query,
    "op9_embedding_near_dedup": op9_metric_join.query,
    "op10_minhash_near_dedup": op10_minhash.query,
    "op11_lm_scoring": op11_pitman_yor.query,
    "op12_phrase_collocations": op12_phrases.query,
    "op13_filter_audit": op13_audit.query,
}

SQL = {
    "op3_source_mixing": op3_mixing.SQL,
    "op5_quality_rules": op5_lines.SQL,
    "op12_phrase_collocations": op12_phrases.SQL,
    "op13_filter_audit": op13_audit.SQL,
}
