"""One query opN_<name> for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillon.llm import audio, best_fit_packing, decontaminate, license_scan, near_dedup, pii, quality, secret_scan, token_count, warc

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_token_count": token_count.query,
    "op3_secret_scan": secret_scan.query,
    "op4_license_scan": license_scan.query,
    "op5_decontamination": decontaminate.query,
    "op6_warc": warc.query,
    "op7_best_fit_packing": best_fit_packing.query,
    "op8_audio_fingerprint": audio.query,
    "op9_minhash_near_dedup": near_dedup.query,
    "op10_pii": pii.query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": secret_scan.oracle_sql(),
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op9_minhash_near_dedup": near_dedup.ORACLE_SQL,
}
